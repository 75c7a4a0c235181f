"""The conversation trie and spelling variants against plain brute force, with the defined cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crease.llm import queries, spelling, trie
from crease.llm.storage import materialise

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- conversation trie
def brute_trie(sequences):
    """``sequences``: {conv_id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv_id, turns in sequences.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv_id)
        ends[tuple(turns)].append(conv_id)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, convs in members.items():
        for depth in range(len(path) + 1):
            leaves[path[:depth]] += children[path] == 0
            saved[path[:depth]] += (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
    return sorted((min(convs), len(path), min(members[path[:-1]]) if path else -1, len(convs), children[path],
                   leaves[path], saved[path],
                   hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest())
                  for path, convs in members.items())


def found_trie(nodes):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
                   r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes.collect())


def ordered(rows):
    """Turns of each conversation in order; ties by role only in these tests."""
    of = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            of[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in of.items()}


def brute_rebuilt(sequences):
    out = {}
    for c, turns in sequences.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = sequences.get(c - c % 5, [])[:h] + turns[h:]
    return out


def conversations(spark, rows):
    return spark.createDataFrame([(*row, "x", -1) for row in rows],
                                 "conv_id long, turn long, role string, text string, path string, depth long")


def alike(n, draw, hot=0.4):
    """Conversations of which many are equal, begin alike, or are one turn of another."""
    common = [("user", "hello"), ("assistant", "hi there"), ("user", "é?")]
    rows = []
    for c in range(n):
        if draw.random() < hot:
            turns = common
        else:
            turns = common[:draw.randint(0, 3)] + [(draw.choice(["user", "assistant"]), draw.choice("abc"))
                                                   for _ in range(draw.randint(1, 4))]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("shard_turns,held,chunk", [(100_000, 200_000, 512), (12, 3, 2), (1, 1, 1)])
def test_trie_equals_brute_force_for_any_shards(spark, monkeypatch, shard_turns, held, chunk):
    rows = alike(400, random.Random(3))
    made = trie.conversation_turns(conversations(spark, rows))
    for name, value in (("SHARD_TURNS", shard_turns), ("HELD_IDS", held), ("CHUNK_IDS", chunk)):
        monkeypatch.setattr(trie, name, value)
    paths = sorted((b"".join(bytes.fromhex(t) for t in r.turns), r.conv_id) for r in made.collect())
    for tasks in (1, 5):  # the same rows in one task, and in five
        parts = []
        for i in range(tasks):
            share = paths[len(paths) * i // tasks:len(paths) * (i + 1) // tasks]
            batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*share[at:at + 7])], names=["path", "conv_id"])
                       for at in range(0, len(share), 7)]
            parts += [row for batch in trie._search(iter(batches)) for row in batch.to_pylist()]
        shards = {row["shard"] for row in parts if row["shard"]}
        assert len(shards) >= tasks and (len(shards) > 30 or shard_turns > 12)
        finished = [row for row in parts if not row["shard"] and not row["chunk"]]
        assert len({(row["depth"], row["conv_id"]) for row in finished}) == len(finished)
    assert found_trie(trie.prefix_trie(made)) == brute_trie(ordered(rows))


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=5), min_size=1, max_size=30))
def test_search_tree_holds_each_prefix_once(sequences):
    distinct = sorted({b"".join(c.encode() * trie.KEY + (7).to_bytes(4, "big") for c in s) for s in sequences})
    shard = trie._Shard(distinct, [1] * len(distinct), list(range(len(distinct))))
    prefixes = {path[:at] for path in distinct for at in range(0, len(path) + 1, trie.ENTRY)}
    order, children, leaves, saved = shard.traverse(shard.boundary())
    assert len(order) == len(prefixes) == len(set(order))
    assert all(order.index(shard.parent[node]) < order.index(node) for node in order if node)
    assert shard.members[0] == len(distinct)


def test_search_trees_are_balanced():
    paths = [i.to_bytes(trie.KEY, "big") + bytes(4) for i in range(1023)]
    shard = trie._Shard(paths, [1] * 1023, list(range(1023)))

    def height(node):
        return 0 if node < 0 else 1 + max(height(shard.less[node]), height(shard.more[node]))

    assert height(shard.below[0]) == 10


def test_trie_of_a_very_long_conversation(spark):
    rows = [(1, i, "user", str(i % 7)) for i in range(20_000)] + [(2, 0, "user", "0"), (2, 1, "user", "x")]
    found = found_trie(trie.prefix_trie(trie.conversation_turns(conversations(spark, rows))))
    assert len(found) == 20_002 and max(r[1] for r in found) == 20_000
    assert found[0][:6] == (1, 0, -1, 2, 1, 2)


def test_trie_defined_cases(spark):
    rows = [(None, 0, "user", "lost"), (5, None, "user", "first"), (5, 0, None, "no role"), (5, 1, "user", None),
            (6, 1, "b", "tie"), (6, 1, "a", "tie"), (6, 1, "a", "tie"), (-7, 0, "", "no role"), (-7, 0, "a", "b"),
            (8, 0, "ab", "c"), (9, 0, "a", "bc"), (10, 0, "user", "x" * 300_000)]
    sequences = ordered(rows)
    assert found_trie(trie.prefix_trie(trie.conversation_turns(conversations(spark, rows)))) == brute_trie(sequences)
    # conversations without turns end at the root
    empty = trie.conversation_turns(conversations(spark, rows)).selectExpr("conv_id", "slice(turns, 1, 0) turns")
    assert found_trie(trie.prefix_trie(empty)) == brute_trie({c: [] for c in sequences})
    assert trie.prefix_trie(trie.conversation_turns(conversations(spark, rows).limit(0))).count() == 0


def test_trie_query_equals_brute_force_over_its_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert found_trie(queries.op12_conversation_trie(spark, SF)) == brute_trie(brute_rebuilt(ordered(rows)))


def test_rebuilt_conversations(spark):
    rows = [(c, i, "user", f"{c}.{i}") for c in [0, 1, 2, 3, 4, 11, 13, 20, 23, 24, 31, 32, 33, 34]
            for i in range(1 if c > 30 else 6 - c % 5)]
    turns = materialise(trie.conversation_turns(conversations(spark, rows)), "turns")
    sequences = brute_rebuilt(ordered(rows))
    assert any(not s for s in sequences.values())
    assert found_trie(trie.prefix_trie(queries.rebuilt(turns))) == brute_trie(sequences)


# ---------------------------------------------------------------- spelling variants
def brute_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        run = ""
        for char in [*(text or ""), " "]:
            if "a" <= char <= "z" or "A" <= char <= "Z" or "À" <= char <= "ÿ":
                run += char.lower() if char.isascii() else char
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 31 == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                counts[run] += 1
            run = ""
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words):
    forms, out = {}, []
    for word, n in words.items():
        near = [(-m, other) for other, m in words.items() if one_edit(word, other)]
        best = min(near, default=None)
        if best and -best[0] >= 10 * n:
            forms[word] = best[1]
        out.append((word, n, len(near)))
    rows = []
    for word, n, n_near in out:
        root = word
        while root in forms:
            root = forms[root]
        rows.append((word, forms.get(word) or "", root, n, n_near, words[forms[word]] if word in forms else -1))
    return sorted(rows)


def found_variants(rows):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n)
                  for r in rows.collect())


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", -1) for i, t in rows], "doc_id long, text string, word string, n long")


def edited(word, draw, letters="abcé"):
    at, kind = draw.randrange(len(word) + 1), draw.randrange(3)
    if kind == 0:
        return word[:at] + draw.choice(letters) + word[at:]
    return word[:at] + (draw.choice(letters) if kind == 1 else "") + word[at + 1:]


@settings(deadline=None, max_examples=300)
@given(st.data())
def test_index_finds_every_near_word_in_just_one_shard(data):
    """All shards of a small vocabulary, made in plain Python."""
    letters = st.text(alphabet="ab", min_size=7, max_size=9)
    words = sorted(set(data.draw(st.lists(letters, min_size=2, max_size=25))))
    for width in (3, None):
        shards = defaultdict(list)
        for word in words:
            for m in {len(word), len(word) - 1} - {6}:
                cuts = [m * j // width for j in range(width + 1)] if width else list(range(m + 1))
                for start, stop in zip(cuts, cuts[1:]):
                    shards[m, start, stop, word[:start], word[len(word) - m + stop:]].append(word)
        found = defaultdict(list)
        for (m, start, stop, _, _), members in shards.items():
            pieces = [word[start:len(word) - m + stop] for word in members]
            index = spelling.PositionIndex(pieces, stop - start)
            for word, piece in zip(members, pieces):
                bits = index.near(piece, stop == m)
                found[word] += [other for i, other in enumerate(members) if bits >> i & 1]
        for word in words:
            assert sorted(found[word]) == [other for other in words if one_edit(word, other)]


@pytest.mark.parametrize("shard_words", [8_192, 3])
def test_variants_equal_brute_force(spark, shard_words):
    draw = random.Random(13)
    stems = ["elephant", "abcabca", "aaaaaaa", "aaaaaaaa", "internationalisation", "Éléphant", "straße×n"]
    text = ["chainings"] * 900 + ["chaininga"] * 60 + ["chainingab"] * 4
    for stem in stems:
        text += [stem] * draw.choice([2, 30, 400])
        for _ in range(40):
            text += [edited(stem, draw)] * draw.choice([1, 2, 3, 25])
    draw.shuffle(text)
    docs = [(i, " ".join(text[i::9])) for i in range(9)]
    words = brute_words(docs)
    told = brute_variants(words)
    assert any(r[1] for r in told) and any(r[2] != r[1] and r[1] for r in told)
    assert found_variants(spelling.spelling_variants(documents(spark, docs), shard_words=shard_words)) == told


def test_variants_defined_cases(spark):
    docs = [(1, None), (2, ""), (None, "Abcdefgh abcdefgh, ABCDEFGH"), (3, "abcdefgh÷ x"), (3, "ÀÀÀÀÀÀÀ àààààààà ÀÀÀÀÀÀÀ"),
            (4, "q" * 300_000 + " " + "q" * 300_000), (5, "short words only"), (-6, "abcdefg_abcdefg9abcdefg")]
    told = brute_variants(brute_words(docs))
    assert len(told) >= 4
    assert found_variants(spelling.spelling_variants(documents(spark, docs))) == told
    assert spelling.spelling_variants(documents(spark, docs).limit(0)).count() == 0


def test_words_that_give_up_early_change_no_count(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 2)
    docs = [(i, "alphabet betabets gammabets alphabet") for i in range(20)]
    assert {(r.word, r.n) for r in spelling.count_words(documents(spark, docs)).collect()} == set(brute_words(docs).items())


def test_chains_of_forms_end_at_their_root(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "w4")], "word string, form string")
    assert {r.word: r.root for r in spelling.follow_forms(forms).collect()} == {f"w{i}": "w9" for i in range(9)} | {"x": "w9"}


def test_variants_query_equals_brute_force_over_its_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found_variants(queries.op13_spelling_variants(spark, SF)) == brute_variants(brute_words(docs))
