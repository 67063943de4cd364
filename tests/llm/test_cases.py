"""Cases all operators and stages must stand: clashing names, null ids and texts, repeated rows, empty tables; and brute force of tree, rules, shards and pipeline."""

import hashlib
import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from platewise.llm import bpe, chat, context_tree, decontaminate, exact_dedup, jaccard, quality, shards, token_files, urls
from platewise.llm.common import without

P = pytest.importorskip("public_tokenizers")
CLASH = ["_id", "_row", "_digest", "_sha", "_s", "_stats", "shard", "ids", "score", "quality_score", "h", "row", "row_key", "dropped_id", "held_out", "n"]
WORDS = [f"w{i}x" for i in range(200)]


def said(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


ITEM = said(90, 25)
TEXTS = [(1, said(1, 60)), (2, said(1, 60)), (3, said(1, 60).replace(" ", "  ")), (4, f"{said(1, 59)} q"), (5, f"{said(2, 30)} {ITEM} {said(3, 30)}"), (6, None), (7, ""), (None, said(4, 30)), (None, said(4, 30)), (8, said(5, 40)), (8, said(5, 40)), (8, said(6, 40)), (9, "z" * 30_000), (10, ITEM)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"{c}{k}" for c in CLASH]) for k, (i, t) in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "one two"), (3, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


RANKS = lambda: bpe.Ranks(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
OPS = {
    "op1": lambda d, s: bpe.digest(d, RANKS()),
    "op2": lambda d, s: context_tree.scored(d),
    "op3": lambda d, s: quality.digest(d, s.read.parquet(f"{s.folder}/labels.parquet")),
    "op7": lambda d, s: jaccard.joined(d),
    "op8": lambda d, s: exact_dedup.groups(d),
    "op10": lambda d, s: token_files.digest(d, P.path("byte_bpe_50k.json"), 3),
}


@pytest.mark.parametrize("name", list(OPS))
def test_operators_give_each_row(spark, docs, folder, name):
    spark.folder = folder
    got = OPS[name](docs, spark).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in TEXTS)
    assert OPS[name](docs.limit(0), spark).collect() == []


def test_operators_of_other_shapes(spark, docs, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.digest(docs, bench).collect()} == {(5, 1), (10, 1)}
    assert Counter(r["doc_id"] for r in shards.digest(docs, target=100_000).collect()) == Counter(i for i, _ in TEXTS)
    assert shards.digest(docs.limit(0)).collect() == []
    assert chat.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


STAGES = dict(corpus_pipeline.STAGES)
LEFT = {"exact_duplicates": [0, 3, 4, 5, 7, 9, 11, 12, 13], "benchmark_leaks": [0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12]}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, docs, folder, name):
    left = STAGES[name](spark, docs, folder)
    assert left.columns == docs.columns
    rows = left.collect()
    assert {(r["doc_id"], r["text"], r["_id"][3:], r["shard"][5:]) for r in rows} <= {(i, t, str(k), str(k)) for k, (i, t) in enumerate(TEXTS)}
    if name in LEFT:
        assert {(r["doc_id"], r["text"]) for r in rows} == {TEXTS[k] for k in LEFT[name]} | ({(6, None)} if name == "exact_duplicates" else set())
    if name == "near_duplicates":
        assert Counter(r["doc_id"] for r in rows) == Counter([1, 5, 6, 7, None, None, 8, 8, 8, 9, 10])
    assert STAGES[name](spark, docs.limit(0), folder).collect() == []


def test_without_by_filter(spark, docs):
    """The way by a filter of keys leaves the same rows as the broadcast."""
    from pyspark.sql import functions as F

    row = F.xxhash64("text")
    dropped = docs.where("doc_id IN (1, 8) OR doc_id IS NULL").select("doc_id", row.alias("row")).distinct()
    ways = [sorted(r["_id"] for r in without(docs, dropped, row, small).collect()) for small in (1000, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == len(TEXTS) - 6


def test_pipeline_end_to_end(spark, folder):
    """Rows of run() by plain Python: with good labels alone, every document passes the first stage."""
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr)
    kept, seen = [], set()
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0)):
        plain = " ".join((t or "").split()) if (t or "").strip() else ""
        if plain not in seen and ITEM not in (t or "") and i != 4:  # 4 shares 56 of 57 shingles with 1
            kept.append((i, t))
        seen.add(plain)
    import base64

    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder, expected = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), []
    for i, t in kept:
        ids = np.array(coder.encode_ordinary(t or ""), "<u4")
        expected.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(expected, key=repr)


def test_rules_as_columns_equal_rules_in_numpy(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [(i, said(i, 30).upper() + "!!" if i % 3 else said(i, int(rng.integers(5, 80))) + ".\n") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    stats = quality.statistics(F.col("text"))
    data = frame.select("doc_id", *[c.alias(n) for n, c in stats.items()]).toPandas().sort_values("doc_id")
    x, y = data[list(stats)].to_numpy(float), np.array([i % 3 > 0 for i, _ in rows], float)
    y[::17] = 1 - y[::17]
    model = quality.fitted(list(stats), x, y)
    assert len(model.rules) > 3
    at = {n: k for k, n in enumerate(stats)}
    raw = np.full(len(x), model.bias)
    for rule in model.rules:
        raw += rule.weight * np.all([(x[:, at[n]] > limit) == above for n, above, limit in rule.tests], axis=0)
    got = quality.scored(frame, model).select("doc_id", "score").toPandas().sort_values("doc_id")["score"]
    assert np.allclose(got, 1 / (1 + np.exp(-raw)))


def test_url_tree_by_plain_python(spark):
    rng = np.random.default_rng(3)
    pages = [f"http://{h}/{a}/{b}/{c}" for h in ("www.a.com", "b.net", "c.org") for a in ("en", "es", "blog") for b in [f"t{i}" for i in range(70)][: 70 if h == "b.net" else 6] for c in ("x", "1")]
    pages = [pages[k] for k in rng.permutation(len(pages))] * 2
    got = {r["page_id"]: r["verdict"] for r in urls.judged(spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")).collect()}

    def ruled(host, path):
        fits = [(len(rule), what) for what, rule in urls.RULES for name, _, start in [rule.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + start)]
        return {"block": 1, "allow": 0}[max(fits)[1]] if fits else None

    distinct = sorted({(u[7:].split("/")[0], u[7 + len(u[7:].split("/")[0]) :]) for u in pages})
    shape = {}
    for h, p in distinct:
        s = [w for w in p.split("/") if w]
        shape[h, p] = ["*" if any(c.isdigit() for c in w) else w for w in s[: urls.DEPTH]] + (["**"] if len(s) > urls.DEPTH else [])
    for d in range(urls.DEPTH):
        nodes = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for (h, p), s in shape.items():
            if len(s) > d:
                n = nodes[h, "/".join(s[:d])][s[d]]
                r = ruled(h, p)
                n[0] += r is not None
                n[1] += r or 0
        to = {}
        for key, children in nodes.items():
            n, b = sum(c[0] for c in children.values()), sum(c[1] for c in children.values())
            for own, (cn, cb) in children.items():
                if own == "*" or len(children) > urls.FAN:
                    to[(*key, own)] = "*"
                    continue
                rate = b / n if n else None
                sd = math.sqrt(rate * (1 - rate) / max(cn, 1)) if rate is not None else None
                z = abs(cb / cn - rate) / sd if cn and sd else 0.0
                if cn >= 5 and z <= 1.96 and len(children) > 1:
                    to[(*key, own)] = "~"
        for (h, _), s in shape.items():
            if len(s) > d and (h, "/".join(s[:d]), s[d]) in to:
                s[d] = to[h, "/".join(s[:d]), s[d]]
    every, wide, own = [0, 0], defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (h, p), s in shape.items():
        if (r := ruled(h, p)) is not None:
            for c in (every, wide["/".join(s)], own[h, "/".join(s)]):
                c[0] += r
                c[1] += 1
    prior, w = every[0] / every[1], urls.WEIGHT
    for k, u in enumerate(pages):
        h = u[7:].split("/")[0]
        p = u[7 + len(h) :]
        t, r = "/".join(shape[h, p]), ruled(h, p)
        all_hosts = (wide[t][0] + w * prior) / (wide[t][1] + w)
        purity = (own[h, t][0] + w * all_hosts) / (own[h, t][1] + w)
        assert got[k] == ("block" if (r if r is not None else purity >= urls.LIMIT) else "allow"), u


def test_shards_of_two_writers_and_old_readers(spark, tmp_path):
    frame = lambda a, b: spark.range(a, b)
    one, two = (shards.Shards(spark, str(tmp_path), target=4000) for _ in range(2))
    waiting = one.written(frame(0, 10))
    assert two.append(frame(10, 20)) == 1
    assert two.vacuum() == [], "a run that is about to be committed stays"
    assert not one.commit(0, waiting) and one.commit(1, one.manifest()["runs"] + waiting)
    old = two.rows(1)
    for k in range(2, 7):
        one.append(frame(10 * k, 10 * k + 10))
        one.compact()
    one.vacuum()
    assert sorted(r["id"] for r in old.collect()) == list(range(10, 20)), "files of recent versions stay"
    rows = one.rows()
    assert sorted(r["id"] for r in rows.collect()) == list(range(70))
    assert {r["shard"].split("/")[0] for r in rows.collect()} == {r["run"] for r in one.manifest()["runs"]}
    gone = one.vacuum(keep=1, grace=0)
    assert gone and one.rows().count() == 70
    with pytest.raises(FileNotFoundError):
        one.commit(one.version(), [{"run": "none", "files": 1, "bytes": 1}])
    assert not two.commit(one.version(), one.manifest()["runs"]), "a fresh claim is respected"
    time.sleep(1.1)
    late = shards.Shards(spark, str(tmp_path), target=4000, grace=1.0)
    assert late.append(frame(70, 80)) == late.version() and late.rows().count() == 80


def test_held_out_split_and_bits(spark):
    rows = [(i, said(i, 30)) for i in range(40)]
    for r in context_tree.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert abs(r["bits_per_byte"] * (len(rows[r["doc_id"]][1]) + 1) + r["score"] * math.log2(10)) < 1e-6 and 0 < r["bits_per_byte"] < 8
