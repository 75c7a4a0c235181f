"""Packing, BPE, WARC, URL rules and page text against brute force, with the defined cases."""

import base64
import hashlib
import random
import zlib
from collections import Counter
from html import unescape

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crease.llm import bpe, htmltext, packing, queries, urlfilter, warc
from crease.llm.tokens import byte_encoder, load_tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = ["  a  b", "x\n foo", "x\n\n  foo \t bar", "it's    ok 's <|endoftext|> z<|endoftext|>q  ", "\x1c a\x1c b",
             "   ", "\n \n", " ", "", "a" * 500 + " " * 7 + "b", "日本語 の テキスト 12 345  x",
             "Á é ́x \n̸= ΑΣ ΟΔΟΣ İ i̇", "x́\ńy", "<|startoftext|>a <|startoftext|> b"]
ANY_TEXT = st.text(alphabet=st.sampled_from(list("abXY 09 \n\t.,'sé́ßΣσ日한\U0001f600\x1c\u2003_-|<>")), max_size=80)


def encoder():
    return byte_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                        (("<|endoftext|>", 50256),))


def documents(spark, rows):
    """doc_id and text beside columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "x", -1, "y") for i, t in rows],
                                 "doc_id long, text string, length string, start long, decoded string")


# ---------------------------------------------------------------- packing
@given(st.integers(1, 5000), st.sampled_from([1, 2, 8, 1024]))
def test_pieces_are_powers_of_two_in_a_row(n, longest):
    pieces = packing.decompose(n, longest)
    assert [s for s, _ in pieces] == [0, *np.cumsum([k for _, k in pieces])[:-1].tolist()]
    assert sum(k for _, k in pieces) == n
    assert all(k & (k - 1) == 0 and k <= longest for _, k in pieces)
    assert max(Counter(k for _, k in pieces if k < longest).values(), default=1) == 1


@settings(deadline=None, max_examples=150)
@given(ANY_TEXT)
def test_fast_byte_ids_are_those_of_the_tokenizer_file(text):
    assert encoder().encode(text) == load_tokenizer(BYTES).encode(text, add_special_tokens=False).ids


def test_packing_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y"), (4, "word " * 3000)]
    rows += [(10 + i, t) for i, t in enumerate(ODD_TEXTS)]
    found = queries.pack_documents(documents(spark, rows), keep_ids=True).collect()
    assert len({r.sequence_id for r in found}) == len(found) and {r.offset for r in found} == {0}
    tokenizer = load_tokenizer(BYTES)
    for doc_id in {i for i, _ in rows}:
        texts = [t for i, t in rows if i == doc_id]
        ids = tokenizer.encode(texts[0] or "", add_special_tokens=False).ids + [0]
        pieces = sorted((r.start, r.length) for r in found if r.doc_id == doc_id)
        assert pieces == sorted(packing.decompose(len(ids)) * len(texts))
        for r in found:
            if r.doc_id == doc_id:
                raw = np.array(ids[r.start:r.start + r.length], "<u4").tobytes()
                assert (bytes(r.ids), r.ids_crc32, r.doc_tokens) == (raw, zlib.crc32(raw), len(ids))
    assert queries.pack_documents(documents(spark, []), keep_ids=True).count() == 0
    with pytest.raises(ValueError):
        packing.pack(documents(spark, []), "", "", {}, max_length=1000)


def test_buckets_hold_one_length_each(spark, tmp_path):
    pieces = queries.pack_documents(documents(spark, [(1, "a b c d e"), (2, "x " * 2000)]), keep_ids=True)
    packing.write_buckets(pieces, str(tmp_path / "buckets"))
    for r in spark.read.parquet(str(tmp_path / "buckets")).collect():
        assert len(r.ids) == 4 * int(r.length)


def test_pieces_are_numbered_inside_their_buckets(spark):
    docs = documents(spark, [(i, "a b c " * (i % 90)) for i in range(400)]).repartition(3)
    numbers = {}
    for r in queries.pack_documents(docs, keep_ids=False).collect():
        numbers.setdefault((r.length, r.bucket_row >> 33), []).append(r.bucket_row & (1 << 33) - 1)
    assert len({part for _, part in numbers}) == 3
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values())


# ---------------------------------------------------------------- BPE
def whole(text):
    tokenizer = load_tokenizer(WORDS)
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False).encode()


@settings(deadline=None, max_examples=150)
@given(st.lists(ANY_TEXT, max_size=4), st.sampled_from([1, 2, 4, 9]))
def test_chunked_encoding_equals_the_whole(texts, cut_bits):
    assert bpe.ChunkEncoder(WORDS, cut_bits).encode(texts) == [whole(t) for t in texts]


def test_cuts_depend_on_content_alone_and_chunks_are_reused():
    random.seed(4)
    shared = " ".join("".join(random.choices("abcdefgh", k=6)) for _ in range(2000))
    texts = [f"{i} is another beginning " * (i + 1) + shared for i in range(5)]
    chunks = [bpe.split_chunks(t) for t in texts]
    assert all("".join(c) == t for c, t in zip(chunks, texts))
    common = set(chunks[0]).intersection(*chunks[1:])
    assert sum(map(len, common)) > 0.8 * len(shared)
    one = bpe.ChunkEncoder(WORDS)
    one.encode(texts[:1])
    first = one.encoded
    assert one.encode(texts) == [whole(t) for t in texts]
    assert one.encoded < 2 * first


def test_joins_are_encoded_anew_where_cuts_go_through_words_and_special_tokens():
    random.seed(9)
    texts = [" ".join("".join(random.choices("abcdefghé日", k=random.randint(1, 12))) for _ in range(300)),
             "<|startoftext|>word<|endoftext|> <|endoftext|>x " * 40, "nobreak" * 300, "it's o'clock\n\nwe'll  "]
    encoder = bpe.ChunkEncoder(WORDS, cut_bits=3)
    assert encoder.encode(texts) == [whole(t) for t in texts]
    # most cuts go through a word: the chunks' own ids there are wrong and the window's replace them
    assert encoder.joins > 150 and encoder.repaired > 0.3 * encoder.joins and encoder.widened == 0
    own = [part for part in encoder._parts(bpe.split_chunks(texts[0], 3), encoder._chunks([bpe.split_chunks(texts[0], 3)]))]
    spliced = b"".join(p[3] if isinstance(p, tuple) else p.ids for p in own)
    assert spliced != whole(texts[0])[0]


def test_a_window_that_does_not_agree_is_widened(monkeypatch):
    encoder = bpe.ChunkEncoder(WORDS, cut_bits=4)
    text = "some plain words that are cut in many places of this text " * 8
    apart = encoder.words.encode_apart
    # an encoder that gives the first word of any window but the whole text another id
    monkeypatch.setattr(encoder.words, "encode_apart", lambda texts: [
        ids if t == text else b"\x01\0\0\0" + ids[4:] for t, ids in zip(texts, apart(texts))])
    assert encoder.encode([text]) == [whole(text)] and encoder.widened > 0


def test_what_a_worker_remembers_is_small():
    from crease.llm.tokens import WordMemo
    memo = WordMemo(queries.tokenizer_file("word_bpe_49k.json"))
    for start in range(0, 400_000, 50_000):
        words = {"w" + np.base_repr(n, 26).translate(str.maketrans("0123456789", "qrstuvwxyz")) for n in range(start, start + 50_000)}
        memo.learn(words)
        memo.trim(words)
    assert 0 < len(memo.ids) + len(memo.old[0]) <= 300_000
    encoder = bpe.ChunkEncoder(queries.tokenizer_file("word_bpe_49k.json"))
    for seed in range(25):
        numbers = np.random.default_rng(seed).integers(0, 5_000, 150_000)
        encoder.encode([" ".join(map(str, numbers))])
    assert 0 < encoder.held <= 16 << 20


def test_bpe_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "ab" * 5000), (5, "Long words " * 5000)]
    rows += [(10 + i, t) for i, t in enumerate(ODD_TEXTS)]
    found = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids), r.decoded)
                    for r in bpe.encode_documents(documents(spark, rows), WORDS).collect())
    expected = Counter()
    for i, t in rows:
        ids, decoded = whole(t or "")
        expected[(i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids,
                  decoded.decode())] += 1
    assert found == expected
    assert bpe.encode_documents(documents(spark, []), WORDS).count() == 0


# ---------------------------------------------------------------- WARC
def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", 7) for r in rows],
                                 "page_id long, url string, html string, key string, digest long")


def expected_records(rows, least=0):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == payload and i is not None]
        newest = max(same, default=None) if len(payload) >= least else None
        refers = newest if newest is not None and page_id != newest else None
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "revisit" if refers is not None else "response", refers))
    return Counter(out)


WARC_ROWS = [(1, "http://www.a.com/x", "hi"), (2, "http://a.com/x", "hi"), (2, "http://a.com/x", "hi"), (3, None, None),
             (4, "", ""), (None, "http://b.c.d/ é\n\r\n: x", "hi"), (5, "http://q", "ünï\r\n\r\nx"), (6, "http://q", "y" * 300_000),
             (7, "a\tb\x00", "\x00\x01")] + [(100 + i, f"http://h{i % 3}.org/p{i % 7}?q={i}", f"p{i // 4}") for i in range(90)]


@pytest.mark.parametrize("least", [0, 3])
def test_warc_round_trip(spark, least):
    read = warc.archive_and_read(pages(spark, WARC_ROWS), least).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read) == \
        expected_records(WARC_ROWS, least)
    assert all(r.intact for r in read)
    assert {r.url for r in read if r.page_id == 3} == {None}
    assert warc.archive_and_read(pages(spark, [])).count() == 0


def test_index_lookup_by_binary_search(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    table = pages(spark, WARC_ROWS)
    captures = warc.write_archives(table, f"{folder}/archives")
    parts = warc.write_index(captures, f"{folder}/index", block_lines=3)
    listed = [(r.first_key, r.path) for r in parts.collect()]
    assert sum(r.lines for r in parts.collect()) == len(WARC_ROWS)
    reader = warc.IndexReader(f"{folder}/index", listed)
    want = Counter(r.key for r in captures.collect())
    for key, n in want.items():
        got = list(reader.captures(key))
        assert len(got) == n and {c[0] for c in got} == {key}
        fields, payload = reader.record(f"{folder}/archives", got[0])
        assert fields["WARC-Type"] in ("response", "revisit")
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == f"sha1:{warc.sha1_base32(payload)}"
    assert not list(reader.captures("com,zzz)/ 1")) and not list(reader.captures("")) and not list(reader.captures("~"))


# ---------------------------------------------------------------- URL rules
def judged(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
        path = tail[:end]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def test_url_rules_against_brute_force(spark):
    random.seed(8)
    hosts = ["com", "example.com", "WWW.example.com", "a.b.example.com", "notexample.com", "x.net", "net", "", "É.net"]
    urls = [f"http://{random.choice(hosts)}{random.choice(['', '/', '/en/', '/en/x', '/es/?q', '/fr/#a', '?/en/'])}"
            for _ in range(300)] + [None, "", "nothing", "a://b", "x\n://net/es/", "://com/", "http://com/a://net/es/"]
    many = [(f"h{i}.org", f"/{'x' * (i % 5)}", "block") for i in range(500)]
    table = spark.createDataFrame([(i % 50, u, "h", "r") for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, row string")
    for rules in (queries.URL_RULES, [], queries.URL_RULES + many):
        found = urlfilter.judge_urls(table, urlfilter.rules_table(spark, rules)).collect()
        assert Counter(map(tuple, found)) == Counter((i % 50, *judged(u, rules)) for i, u in enumerate(urls))
    assert urlfilter.judge_urls(table.limit(0), urlfilter.rules_table(spark, queries.URL_RULES)).count() == 0


def test_false_hits_of_the_bloom_filter_are_removed(spark):
    rules = urlfilter.rules_table(spark, [(f"h{i}.org", "/", "block") for i in range(200)])
    prepared = urlfilter.prepare_rules(rules)
    table = spark.createDataFrame([(i, f"http://x{i}.org/") for i in range(3000)], "page_id long, url string")
    urls = table.select("page_id", urlfilter.url_host(table.url).alias("host"), urlfilter.url_path(table.url).alias("path"))
    crowded = urlfilter.possible_hits(urls, urlfilter.bloom_filter(prepared, 4), 4)
    assert crowded.where("rule IS NOT NULL").count() > 0  # four blocks for 200 rules let strangers through
    assert {r.verdict for r in urlfilter.judge_urls(table, rules).collect()} == {"allow"}


def test_the_filter_is_not_carried_in_rows_and_reads_one_word(spark):
    """The time of a probe does not grow with the list."""
    import time
    table = spark.range(40_000).selectExpr("id AS page_id", "concat('http://a', id, '.x', id % 977, '.org/p/q') AS url")
    taken = []
    for n in (5_000, 100_000):
        rules = spark.range(n).selectExpr("concat('h', id, '.net') AS host", "'/' AS path", "'block' AS verdict")
        prepared = urlfilter.prepare_rules(rules)
        urls = table.select("page_id", urlfilter.url_host(table.url).alias("host"), urlfilter.url_path(table.url).alias("path"))
        bloom = urlfilter.bloom_filter(prepared, n // urlfilter.KEYS_PER_BLOCK).persist()
        words = bloom.first().bloom
        assert len(words) == n // urlfilter.KEYS_PER_BLOCK
        found = urlfilter.possible_hits(urls, bloom, len(words))
        assert "bloom" not in found.columns
        best = []
        for _ in range(3):
            start = time.time()
            found.write.format("noop").mode("overwrite").save()
            best.append(time.time() - start)
        taken.append(min(best))
        bloom.unpersist()
    assert taken[1] < 3 * taken[0] + 2


# ---------------------------------------------------------------- page text
PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body>"
        "<header class='top'>Site</header><nav><ul><li><a href='/a'>A</a></li></ul></nav><!-- ad 1 --><div class=\"ad\">Buy"
        "</div>{body}<footer>&copy; x</footer></body></html>")


@pytest.mark.parametrize("body, text", [
    ("<article><h1>Head</h1><p><b>One &amp; two<br>three</b><p>Four\n  five</p>&lt;six&gt;</article>",
     "Head\nOne & two three\nFour five\n<six>"),
    ("<main><p>a</p><aside>no</aside><div id='comments'><p>no</p></div><form>no</form><p>b</p></main>", "a\nb"),
    ("<article class='post has-sidebar'><header><h1>H</h1></header><p>x</p><footer>by</footer></article>"
     "<article class='comment'>no</article>", "H\nx"),
    ("<div class='page-with-sidebar'><article><p>x</p><ul><li>1<li>2</ul></article><div class=sidebar>no</div></div>",
     "x\n1\n2"),
    ("<div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div><div><p>text</p></div>", "text"),
    ("<article><p>a < b && c &am d &quo; e&nbsp;f</p><p hidden>no</p><p style='display: none'>no</p><table><tr><td>1"
     "<td>2</table></article>", None),
    ("<div class='cookie-notice'>no</div>", ""),
    ("<article><p>cut <b>off", "cut off"),
])
def test_main_text(body, text):
    if text is None:
        text = "a < b && c &am d " + unescape("&quo;") + " e f\n1\n2"
    page = PAGE.replace("{body}", body) if body != "<article><p>cut <b>off" else f"<html><body>{body}"
    assert htmltext.main_text(page, {}) == text


def test_a_page_is_sent_its_own_places_only(spark):
    page = "<html><body><div class='k{kind}'><p>Same {kind}</p></div><div class='y'><p>Own {i}</p></div></body></html>"
    rows = [(f"{i % 2}.org" if i < 2 else "a.b", page.format(kind=i % 4, i=i)) for i in range(60)] + [("a.b", None)]
    table = spark.createDataFrame(rows, "host string, html string").selectExpr("*", "xxhash64(html) AS page")
    importance = htmltext.site_importance(table)
    found = htmltext.known_by_page(table, importance).collect()
    assert importance.count() == 2 + 2 + 4 * 2 and len(found) == 58
    assert {len(r.known) for r in found} == {6} and len({r.page for r in found}) == 58


def test_entropy_removes_what_all_pages_of_a_site_share(spark):
    rows = [(i, f"http://Site{i // 40}.com/{i}", f"<html><body><div><div>Welcome here</div><div><p>Story {i} has its own words"
             f"</p></div></div><div>All of it stays</div></body></html>") for i in range(80)]
    rows += [(1000 + i, "http://one.com/x", "<body><div>Welcome here</div><p>one</p></body>") for i in range(20)]
    rows += [(2000, None, None), (2001, "http://q", ""), (None, "", "<p>x</p>"), (2002, "h", "<p>" + "long " * 50_000)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    found = {r.page_id: r for r in htmltext.extract_text(table).collect()}
    assert found[3].text == "Story 3 has its own words"
    importance = htmltext.site_importance(table.selectExpr("html", "lower(url) AS host")).collect()
    assert all(0 <= r.presentation <= 1 for r in importance)
    # equal pages count once: no place of one.com stands on enough different pages
    assert found[1005].text == "Welcome here\none"
    assert found[2000].text == "" and found[2001].n_chars == 0 and found[None].text == "x"
    assert found[2002].n_chars == 5 * 50_000 - 1
    assert htmltext.extract_text(table.limit(0)).count() == 0


def test_copies_with_other_menus_on_one_host_keep_their_text(spark):
    page = ("<html><body><nav><ul>{menu}</ul></nav><article><h1>{head}</h1>{ad}<p>{text}</p>{own}</article></body></html>")
    own = "<blockquote>Said once</blockquote><table><tr><td>1 2 3</td></tr></table>"

    def copy(i):
        return page.format(menu="".join(f"<li><a href='/{j}'>Item {j}</a></li>" for j in range(i + 1)), head="Copied",
                           ad=f"<div class='ad'>Buy {i}</div>" * (i % 3), text="The same words", own=own)

    rows = [(i, "http://only.com/x", copy(i)) for i in range(12)] + [(100 + i, "http://many.com/x", copy(i)) for i in range(12)]
    rows += [(200 + i, "http://many.com/y", page.format(menu="", head=f"Head {i}", ad="", text=f"Story {i}", own=""))
             for i in range(12)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in htmltext.extract_text(table).collect()}
    assert {found[i] for i in [*range(12), *range(100, 112)]} == {"Copied\nThe same words\nSaid once\n1 2 3"}
    assert [found[200 + i] for i in range(12)] == [f"Head {i}\nStory {i}" for i in range(12)]


def test_templates_are_found_among_copies(spark):
    page = ("<html><body><div class='top'>{ad}<div>Welcome here</div></div><div class='story'><p>Story {i} has its own words"
            "</p></div></body></html>")
    rows = [(100 * i + j, "http://a.b/", page.format(i=i, ad="<div class='ad'>Buy</div>" * (j % 2) + "<nav>M</nav>" * (j % 3)))
            for i in range(12) for j in range(6)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in htmltext.extract_text(table).collect()}
    assert all(found[100 * i + j] == f"Story {i} has its own words" for i in range(12) for j in range(6))


def test_places_that_look_alike_have_low_importance():
    page = "<html><body><div class='x'><p>Same words</p></div><div class='y'><p>Own words {}</p></div></body></html>"
    rows = Counter()
    for i in range(50):
        for place, shown, what, *_ in htmltext.site_rows(htmltext.parse(page.format(i))):
            rows[place, shown, what] += 1
    known = {}
    for place in {p for p, _, _ in rows}:
        shown = [n for (p, s, _), n in rows.items() if p == place and s]
        texts = [n for (p, s, _), n in rows.items() if p == place and not s]
        m = sum(shown)
        known[place] = (1 - sum(n * np.log(n) for n in shown) / (m * np.log(m)), len(shown),
                        1 - np.mean(np.log(texts)) / np.log(m) if texts else None, False)
    assert htmltext.main_text(page.format(7), known) == "Own words 7"


@pytest.mark.parametrize("few", [True, False])
def test_importances_reach_pages_by_broadcast_or_join(spark, monkeypatch, few):
    monkeypatch.setattr(htmltext, "BROADCAST_PLACES", 10_000 if few else 0)
    page = "<html><body><div class='x'><p>Same words</p></div><div class='y'><p>Own words {}</p></div></body></html>"
    table = spark.createDataFrame([(i, "http://a.b/", page.format(i)) for i in range(30)],
                                  "page_id long, url string, html string")
    assert {r.text for r in htmltext.extract_text(table).collect()} == {f"Own words {i}" for i in range(30)}


@pytest.mark.parametrize("body", ['<h2 id="related">Kept</h2>', '<p class="share-of-gdp">Kept</p>',
                                  '<section id="legal"><p>Kept</p></section>', '<div class="warning">Kept</div>',
                                  '<figure class="ad-hoc"><figcaption>Kept</figcaption></figure>'])
def test_names_decide_nothing_inside_the_article(body):
    assert htmltext.main_text(f"<body><article><p>One</p>{body}</article></body>", {}) == "One\nKept"


def test_adverts_and_comments_inside_the_article_go():
    page = "<article><p>a</p><div class='ad big'>no</div><ul id=comments><li>no</ul><p class=ad>b</p></article>"
    assert htmltext.main_text(page, {}) == "a\nb"


def test_a_quote_that_is_never_closed_prints_no_markup():
    assert htmltext.main_text('<article><p>a</p><p title="x>broken</p><p>b</p></article>', {}) == "a\nbroken\nb"
    assert htmltext.main_text("<article><p>a</p><p title='x>y", {}) == "a\ny"


def test_extraction_is_linear_in_depth():
    import time
    taken = []
    for depth in (10_000, 100_000):
        page = f"<body>{'<div class=k>' * depth}<p>deep</p>{'</section>' * depth}{'</div>' * depth}<p>x</p></body>"
        known = {node.place: (0.5, 2, None, False) for node in htmltext.elements(htmltext.parse(page[:5_000]))}
        start = time.time()
        assert htmltext.main_text(page, known) == "deep\nx"
        taken.append(time.time() - start)
    assert taken[1] < 25 * taken[0] + 1


def test_the_tree_alone_removes_noise_from_the_given_pages_and_no_article(spark, monkeypatch):
    """Without names, menu rule or the article's tag."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    sites = pages.selectExpr("lower(coalesce(regexp_extract(url, '^[^:]*://([^/?#]*)', 1), '')) AS host", "html")
    known = {}
    for r in htmltext.site_importance(sites).collect():
        known.setdefault(r.host, {})[r.place] = (r.presentation, r.ways, r.content, r.prose)
    rows = [(r.host, htmltext.parse(r.html)) for r in sites.collect() if r.html]
    articles = [htmltext.kept_texts(root, {}) for _, root in rows]
    monkeypatch.setattr(htmltext, "is_noise", lambda node, in_article: False)
    monkeypatch.setattr(htmltext, "menu_like", lambda node: False)
    noise = removed = 0
    for (host, root), article in zip(rows, articles):
        whole = htmltext._texts(root, False, set())
        left = htmltext._texts(root, False, htmltext.low_branches(root, known.get(host, {})))
        assert not [block for block in article if block not in left]
        noise += len(whole) - len(article)
        removed += len(whole) - len(left)
    assert noise > 15_000 and removed > 0.85 * noise


def plain_prose(pages):
    """Places of a site that are prose: path -> whether its texts have 80 characters on average, most not in links."""
    sums = {}
    for root in pages:
        for node in htmltext.elements(root):
            for kid in node.kids:
                if isinstance(kid, htmltext.Text):
                    n, chars, links = sums.get(node.place, (0, 0, 0))
                    sums[node.place] = (n + 1, chars + len(kid.text), links + kid.link_chars)
    return {place: chars >= 80 * n and 2 * links < chars for place, (n, chars, links) in sums.items()}


def test_prose_holders_equal_a_plain_version(spark):
    r = random.Random(5)

    def words(n):
        return " ".join(r.choice("alpha beta gamma delta omega sigma".split()) + str(r.randint(0, 99)) for _ in range(n))

    rows = []
    for i in range(20):
        menu = "".join(f"<li><a href='/{j}'>{words(1)}</a></li>" for j in range(r.randint(2, 6)))
        story = "".join(f"<p>{words(r.randint(20, 60))}</p>" for _ in range(r.randint(2, 5)))
        rows.append((i, "http://s.it/", f"<body><div class=a><ul>{menu}</ul></div><div class=b>{words(3)}</div><div class=c>"
                     f"<h1>{words(4)}</h1>{story}<ul><li>{words(1)}</li></ul></div><div class=d>{words(5)}</div></body>"))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    importance = {x.place: x for x in htmltext.site_importance(table.selectExpr("html", "'s.it' AS host")).collect()}
    roots = [htmltext.parse(h) for _, _, h in rows]
    told = plain_prose(roots)
    assert {p: x.prose for p, x in importance.items() if p in told} == told and sum(told.values()) == 1
    found = {x.page_id: x.text for x in htmltext.extract_text(table).collect()}
    for (i, _, html), root in zip(rows, roots):
        story = next(n for n in htmltext.elements(root) if n.key == "div.c")
        assert found[i] == "\n".join(htmltext._texts(story, True, set()))
