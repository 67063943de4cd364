"""The operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from platewise.llm import bpe, chat, context_tree, decontaminate, exact_dedup, jaccard, quality, shards, token_files, urls

P = pytest.importorskip("public_tokenizers")
WORDS = [f"w{i}x" for i in range(300)]


def said(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


BASE = said(1, 200)
TEXTS = [None, "", "  ", "a", "A b", "a  b", "a\tb", BASE, BASE, BASE.upper(), BASE.replace("w7x", "q"), BASE + " tail", said(2, 200), "x" * 5000, "日本 é\n\nok  ", "don't  'll !!! 12ab\x00 \x85z", said(3, 6000), "</s>[INST] \\ <|end|>"]
ROWS = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(7, BASE, "clash")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, score string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def test_bpe(docs, none):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Ranks(path, P.PATTERN)
    expected = Counter()
    for i, t, _ in ROWS:
        ids = np.array(coder.encode_ordinary(t or ""), "<u4")
        expected[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    for most in (1 << 16, 5):
        assert Counter(map(tuple, bpe.digest(docs, own, most).collect())) == expected
    assert bpe.digest(none, own).collect() == []


def test_bpe_cuts_each_piece_and_folds_each_word_once(monkeypatch):
    """A task does no work twice: 2,000 texts of four pieces, in portions, with punctuation that makes other pieces of known words."""
    import base64

    import pyarrow as pa
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own, cut, folded = bpe.Ranks(path, P.PATTERN), [], Counter()
    fold_many = bpe.Ranks.fold_many
    monkeypatch.setattr(bpe.Ranks, "fold_many", lambda self, ws: folded.update(ws.to_pylist() if isinstance(ws, pa.Array) else [w.decode() for w in ws]) or fold_many(self, ws))
    coder = bpe.Encoder(own, (pa.array([], pa.string()), pa.array([], pa.large_binary())))
    find, coder.find = coder.find, lambda text: cut.append(len(text)) or find(text)
    texts = [f"a{i % 7} the{'.' * (i // 500)} zyx\n{'qv' * (i % 3)}w" for i in range(2000)]
    got = [x for part in bpe.portions(pa.array(texts), 10_000) for x in coder(part).to_pylist()]
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == [np.array(plain.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert set(folded.values()) == {1}
    assert sum(cut) < 100 * len(list(bpe.portions(pa.array(texts), 10_000)))  # some 50 characters of distinct pieces each


def test_bpe_pieces_are_cut_only_where_no_word_spans(seed=3):
    """Texts of every white space, NUL, SOH, runs and ends, in slices, with a cache that is emptied again and again."""
    import base64

    import pyarrow as pa
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain, own, rng = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Ranks(path, P.PATTERN), np.random.default_rng(seed)
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert all(bpe.odd(pa.array([f"a{c}b" for c in spaces if c not in " \n"])).to_pylist())
    some = [*"abst'1½é日\u0301!.\x00\x01😀", "'ll", "ing", "x" * 150, *spaces]
    texts = ["".join(rng.choice(some if i % 2 else [*some[:16], " ", "\n"], int(rng.integers(0, 40)))) for i in range(1500)]
    texts = [None if i % 97 == 0 else " ".join(t.split(" ")).strip() if i % 4 == 0 else t for i, t in enumerate(texts)]
    words = pa.array([" a", "ing"])
    coder = bpe.Encoder(own, (words, own.fold_many(words)))
    coder.ROOM = 200
    ids = [coder(part) for part in bpe.portions(pa.array(texts, pa.string()).slice(5), 900)]
    assert [x for part in ids for x in part.to_pylist()] == [np.array(plain.encode_ordinary(t or ""), "<u4").tobytes() for t in texts[5:]]
    assert [x.decode() for part in ids for x in own.joined(part).to_pylist()] == [t or "" for t in texts[5:]]
    assert not all(bpe.odd(pa.array(texts)).to_pylist())


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    got = sorted(map(tuple, token_files.digest(docs, path, 3).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(i for i, _, _ in ROWS)
    start = 0
    by_id = {i: t for i, t, _ in ROWS}
    for i, at, n, crc in got:
        ids = np.array([*coder.encode(by_id[i] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (at, n, crc) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += n
    assert token_files.digest(none, path, 3).collect() == []


def test_token_files_follow_the_library(spark):
    """Added tokens in texts, white space of all kinds, long words, null and repeated ids: ids of whole texts."""
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "a\n\nb", " lead", "trail ", "a\u00a0b", "a\tb", "a\u3000b c", "one\ntwo three", "n\x00ul", "é ß日本 ok", "y" * 20_000, "", None, "it's  we'll", "a\x1cb", "\u2028"]
    rng = np.random.default_rng(0)
    texts += ["".join(rng.choice(list("ab \n\té<|>endoftx'1."), 60)) for _ in range(300)]
    rows = [(int(i) if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, "a"), (3, "a"), (3, "b")]
    got = sorted(map(tuple, token_files.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, 4).collect()), key=lambda r: r[1])
    expected, start = Counter(), 0
    for i, t in rows:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((i, n, c) for i, _, n, c in got) == expected
    assert [(-1 if r[0] is None else r[0]) for r in got] == sorted(-1 if i is None else i for i, _ in rows)
    for _, at, n, _ in got:
        assert at == start
        start += n


def test_repair_random_access():
    ids = np.random.default_rng(0).choice(50, 20_000, p=np.r_[0.5, np.full(49, 0.5 / 49)])
    block = token_files.Block(token_files.Block.packed(ids))
    assert len(block.rules) and (block.read(0, len(ids)) == ids).all() and (block.read(777, 99) == ids[777:876]).all()


def test_exact(spark, docs, none):
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    con.register("documents", documents)
    con.execute("CREATE VIEW d AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents")
    expected = con.execute(exact_dedup.SQL.replace("FROM documents", "FROM d")).fetchall()
    assert sorted(map(tuple, exact_dedup.groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == sorted(expected)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({e[1] for e in expected})
    assert exact_dedup.groups(none).collect() == []


def test_jaccard(docs, none):
    for n, percent in ((3, 90), (5, 80)):
        sets = {}
        for i, t, _ in ROWS:
            w = words(t)
            sets[i] = set() if not w else {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        parent = {i: i for i in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        parent[a] = parent[b] = min(parent[a], parent[b])
        got = jaccard.joined(docs, n, percent).collect()
        assert len(got) == len(ROWS) and all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), parent[r["doc_id"]]) for r in got)
    assert jaccard.joined(none).collect() == []


def test_jaccard_wide_groups():
    """Chains and blocks: many entries of one shingle, over several batches."""
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.choice(400, 300, replace=False)).astype(np.uint64) for _ in range(40)]
    sets += [s[:-1] for s in sets[:10]]
    edges = jaccard.forest(sets, 90, columns=64)
    assert sorted(tuple(sorted(e)) for e in edges) == [(i, i + 40) for i in range(10)]


def test_components(spark):
    """A chain, a hub of 5,000 nodes and small groups: by one task, and by rounds over many."""
    from platewise.llm.common import components

    rng = np.random.default_rng(0)
    pairs = [(i, i + 1) for i in range(500)] + [(100_000, i) for i in range(6000, 11_000)] + [(7, 6000)] + rng.integers(200_000, 200_400, (150, 2)).tolist()
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    expected = {x: top(x) for a, b in pairs if a != b for x in (a, b)}
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a long, b long").repartition(8)
    for local in (1 << 20, 64):
        assert dict(map(tuple, components(edges, local=local).collect())) == expected


def linked(rows, n, percent):
    """doc_id, size of the set and component of each row, by comparing all pairs of rows."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(set() if not w else {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and rows[a][0] is not None and rows[b][0] is not None:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i) if i is not None else None
    return sorted(((i, len(sets[k]), least[top(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def test_jaccard_wide_blocks(spark, monkeypatch):
    """Near copies of one text, more or less edited and cut: blocks of many parts and bands, chains, several cores."""
    rng = np.random.default_rng(1)
    base, rows = rng.choice(WORDS, 120).tolist(), []
    for i in range(300):
        w = list(base)
        for k in rng.integers(0, len(w), int(rng.integers(0, 9))):
            w[k] = f"n{rng.integers(0, 50)}"
        rows.append((i, " ".join(w[: len(w) - int(rng.integers(0, 30)) * (i % 3 == 0)])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = linked(rows, 3, 90)
    assert len({c for _, _, c in expected}) > 50
    for part, wide in ((40, 8), (512, 64)):
        monkeypatch.setattr(jaccard, "PART", part)
        monkeypatch.setattr(jaccard, "WIDE", wide)
        assert sorted((tuple(r)[:3] for r in jaccard.joined(frame).collect()), key=repr) == expected


def test_jaccard_common_passage_over_many_tasks(spark):
    """A passage that each task meets once joins no unlike documents; a near copy stays a candidate, tiny sets are none."""
    rng = np.random.default_rng(2)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{' '.join(f'w{x}' for x in rng.integers(0, 10**9, 200))} {passage}") for i in range(80)]
    rows += [(80, f"{rows[0][1]} end"), (81, "a b c d"), (82, "a b c d e")]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    assert {r[2] for r in jaccard.joined(frame).collect() if r[0] in (0, 80)} == {0}
    found = jaccard.signatures(frame, 3, 90).localCheckpoint()
    entries = jaccard.entries_of(found, 90, "doc_id")
    assert {tuple(r) for r in jaccard.candidates(entries, 90).collect()} == {(0, 80)}
    assert entries.where("doc > 80").isEmpty()


def test_jaccard_ids_that_repeat(spark):
    a, b = said(50, 40), said(51, 40)
    rows = [(1, f"{a} x"), (2, f"{b} x"), (5, a), (5, b), (None, a), (9, None), (9, ""), (5, a)]
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == sorted([(1, 39, 1), (2, 39, 2), (5, 38, 1), (5, 38, 2), (None, 38, None), (9, 0, 9), (9, 0, 9), (5, 38, 1)], key=repr)


def test_decontamination(spark, docs, none):
    item = said(9, 30).split()
    edited = item[:14] + ["new"] + item[15:]
    rows = [(1, f"{said(4, 50)} {' '.join(item).upper()} {said(5, 70)}"), (2, " ".join(item[:12])), (3, None), (4, " ".join(item)), (5, f"a {' '.join(edited[:29])}"), (None, " ".join(item)), (6, "one two here"), (7, said(8, 90))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "one two"), (3, None), (4, said(6, 40))], "item_id long, text string")
    small = spark.createDataFrame(rows, "doc_id long, text string")
    expected = set()
    for i, t in rows:
        for k, b in bench.collect():
            own, w = words(b), words(t)
            width = min(5, len(own))
            grams = lambda v: [tuple(v[j : j + width]) for j in range(len(v) - width + 1)]
            a, c = Counter(grams(own)), grams(w)
            n = sum(a.values())
            if own and any(5 * sum((Counter(c[s : s + n]) & a).values()) >= 4 * sum((Counter(c[s : s + n]) | a).values()) for s in range(len(c) - n + 1)):
                expected.add((i, k))
    assert expected >= {(1, 1), (4, 1), (None, 1), (6, 2)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.digest(small, bench).collect()} == expected
    left = decontaminate.decontaminated(small, bench)
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in expected}
    assert decontaminate.digest(none, bench).collect() == [] and decontaminate.digest(docs, bench.limit(0)).collect() == []


def test_decontamination_of_short_documents(spark):
    """A document with fewer shingles than an item is one window, here against all items by brute force."""
    item = said(31, 59).split()
    cuts = [item[:55], item[4:], item[:50], item[:48], item[:47], item[3:56], [*item[:20], "new", *item[21:57]], [*item[:2], "new", *item[3:57]], item[:58], item, item[:30] * 2, ["a", *item[:55]], item[:4], []]
    rows = [(i, " ".join(w)) for i, w in enumerate(cuts)]
    loop = " ".join(["x y z"] * 12)
    rows += [(90, " ".join(["x y z"] * 11)), (91, " ".join(["x y z"] * 7))]
    bench = [(1, " ".join(item)), (2, loop), (3, "one two")]
    expected = {}
    for i, t in rows:
        for k, b in bench:
            own, c = words(b), words(t)
            width = min(5, len(own))
            grams = lambda v: [tuple(v[j : j + width]) for j in range(len(v) - width + 1)]
            a, c = Counter(grams(own)), grams(c)
            n = min(sum(a.values()), len(c))
            found = [(sum((Counter(c[s : s + n]) & a).values()) / sum((Counter(c[s : s + n]) | a).values()), -s) for s in range(len(c) - n + 1)]
            if found and max(found)[0] >= 0.8:
                expected[i, k] = (-max(found)[1], n + width - 1, round(max(found)[0], 6))
    assert {(0, 1), (1, 1), (2, 1), (90, 2)} <= expected.keys() and not {(4, 1), (91, 2)} & expected.keys()
    small = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.digest(small, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"], r["similarity"]) for r in got} == expected


def test_context_tree(docs, none):
    import math

    got = {r["doc_id"]: r for r in context_tree.scored(docs).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in ROWS}
    counts = Counter(w for i, t, _ in ROWS if not held[i] for w in [*words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    for i, t, _ in ROWS:
        w = [*words(t), "\n"]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(x in counts for x in w), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
    assert context_tree.scored(none).collect() == []


def test_context_tree_opens_at_any_size(spark, monkeypatch):
    """The passes over parts and groups against the tree in one place, with all contexts seen twice, on 400 KB of text."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS, 90)) + f" rare{i // 2:05d} {i}") for i in range(1000)]
    monkeypatch.setattr(context_tree, "GROUP", 50_000)
    got = {r["doc_id"]: r["score"] for r in context_tree.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = [Counter() for _ in range(context_tree.DEPTH + 1)]
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            raw = b"\n" * context_tree.DEPTH + t.encode() + b"\n"
            for k in range(context_tree.DEPTH, len(raw)):
                for d in range(context_tree.DEPTH + 1):
                    seen[d][int.from_bytes(raw[k - d : k], "big"), raw[k]] += 1
    contexts, tables = [], []
    for pairs in seen:
        total = Counter()
        for (c, _), n in pairs.items():
            total[c] += n
        contexts.append(np.array(sorted(c for c, n in total.items() if n >= 2), np.int64))
        place = {c: k for k, c in enumerate(contexts[-1].tolist())}
        tables.append(np.zeros((len(place), 256)))
        for (c, b), n in pairs.items():
            if c in place:
                tables[-1][place[c], b] = n
    assert sum(min(t.sum(1)) == 2 for t in tables) >= 2 and tables[0].sum() > 400_000
    tree = context_tree.Tree(contexts, tables)
    whole = tree.scores(tree.children, tree.offsets, tree.logs, *context_tree.stream([context_tree.tokens(t) for _, t in rows]))
    assert all(abs(got[i] - s) < 1e-5 * abs(s) for (i, _), s in zip(rows, whole.tolist(), strict=True))


def test_context_tree_is_a_distribution():
    context = [np.arange(1) for _ in range(1)]
    counts = [np.zeros((1, 256)) for _ in range(1)]
    counts[0][0, 97:107] = 9
    for _ in range(context_tree.DEPTH):
        context.append(np.zeros(0, np.int64))
        counts.append(np.zeros((0, 256)))
    tree = context_tree.Tree(context, counts)
    assert abs(np.exp(tree.logs[0].astype(float)).sum() - 1) < 1e-5 and tree.logs[0][100] > tree.logs[0][0]


def test_quality(spark, none):
    rows = [(i, said(i, 40) if i % 4 else " ".join(w.upper() + "!!" for w in said(i, 40).split()), 1 if i % 4 else 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, None) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.digest(docs, labels).collect()}
    assert len(got) == 401 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(got[i]["predicted"], q) for i, _, q in rows if got[i]["held_out"]]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)
    assert all(r["score"] == 0.5 for r in quality.digest(docs, labels.limit(0)).collect())
    assert quality.digest(none, labels).collect() == []


def test_chat(spark):
    rows = [(1, 0, "user", "a <|end|> \\"), (1, 1, "user", None), (1, 2, "assistant", "b\nc"), (1, 2, "assistant", "b\nc"), (2, None, None, ""), (2, 5, "assistant", "日<|next|>本"), (2, 700, "user", "</s>")]
    conversations = chat.with_escapes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.digest(conversations).collect()}
    turns = defaultdict(list)
    for c, k, role, t in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        turns[c].append((-1 if k is None else k, role or "", t or ""))
    for c, own in turns.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(own), len(loss))
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    shown = {r["conv_id"]: r["formatted"] for r in chat.formatted(conversations).collect()}
    assert shown[1].count("<|start|>") == 2 and shown[1].count("<|end|>") == 2


def test_urls(spark):
    rows = [(1, "http://A.example.com/en/1"), (2, "https://www.example.com/en/2?x"), (3, "http://x.com/de"), (4, "http://b.net/es/9"), (5, None), (6, "nothing"), (7, "ftp://b.net"), (8, "http://b.org/en/5#t")]
    rows += [(100 + i, f"http://h{i % 5}.example.com/en/{i}") for i in range(60)]
    got = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert (got[2]["rule"], got[2]["verdict"]) == ("www.example.com/en/", "allow") and got[3]["rule"] == "com/" and got[4]["rule"] == "net/es/"
    assert (got[5]["host"], got[5]["path"], got[6]["host"], got[7]["path"]) == ("", "", "", "") and got[8]["rule"] is None and got[8]["verdict"] == "block"
    assert len(got) == len(rows) and urls.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_shards(spark, docs, tmp_path):
    table = shards.Shards(spark, str(tmp_path), target=20_000)
    for _ in range(6):
        table.append(docs)
        table.compact()
    runs = table.manifest()["runs"]
    assert table.rows().drop("shard").count() == 6 * len(ROWS) and sum(r["files"] for r in runs) < 6 * 4
    assert not table.commit(0, []), "a version is never replaced"
    table.vacuum()
    assert table.rows().count() == 6 * len(ROWS)
    assert sorted(map(repr, shards.digest(docs).select("doc_id", "n_chars_read").collect())) == sorted(f"Row(doc_id={i}, n_chars_read={len(t or '')})" for i, t, _ in ROWS)
