"""Quality rules, mixing, encoding, search, URLs and edit-aware counts against plain versions."""

import dataclasses
import random
import re
from collections import Counter

import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import connect, differences
from pricewright.llm import edit_counts, queries, quality_rules, url_filter
from pricewright.llm import mixing
from pricewright.llm.mixing import KEYS, mix_sources, permuted
from pricewright.llm.piece_codec import ChunkCodec, encode_documents
from pricewright.llm.tile_search import nearest, search_group

MODEL = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
RANKS = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, sf_dir, name):
    assert differences(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE[name]) == []


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) < set(entry.queries()) and "pipeline" in entry.queries()


# -- quality rules --------------------------------------------------------------------


def plain_measures(text):
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in quality_rules.SYMBOLS for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated)


def test_measures(odd, odd_rows):
    got = quality_rules.judge(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter()
    for doc, text, _ in odd_rows:
        m = plain_measures(text)
        want[(doc, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert Counter(map(tuple, got.collect())) == want


def test_rules_name_what_they_break(spark):
    good = "the river and the stone of a small light under the bridge in winter " * 5
    distinct = " ".join(f"{w}{i}" if i % 3 else "the" for i, w in enumerate(good.split()))
    rows = [(1, distinct), (2, distinct.replace(" ", "$ ")), (3, " ".join(f"word{i}" for i in range(60)))]
    got = {r["doc_id"]: r["broken_rules"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: ["symbols"], 3: ["stop_words"]}


def test_no_python_in_the_native_plans(spark, sf_dir):
    for name in ("op1_line_dedup", "op5_quality_rules", "op6_source_mixing"):
        text = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", text)


# -- mixing ----------------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2)):
    """The same rule as a loop: stop sources at their caps until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def _taken(mix):
    return {
        (r["doc_id"], r["source"], r["__text_hash"], r["__part"]): (r["__size"], r["__source_size"], r["__target"], r["taken"] or 0)
        for r in mix.documents.join(mix.taken().withColumnsRenamed({k: f"of{k}" for k in KEYS}),
            [F.col(k).eqNullSafe(F.col(f"of{k}")) for k in KEYS], "left").collect()
    }


def test_mix(odd, odd_rows):
    docs = odd.withColumn("target", F.lit("mine"))
    mix = mix_sources(docs, block_words=16)
    assert {(r["size"], r["target"], r["kept"]) for r in mix.documents.collect()} == {(1.5, "mine", "kept")}
    got = _taken(mix)
    assert len(got) == len(odd_rows)
    sizes = Counter()
    for _, text, source in odd_rows:
        sizes[source] += len(words(text))
    want = plain_targets(sizes)
    taken = Counter()
    for (_, source, *_), (size, source_size, target, n) in got.items():
        assert source_size == sizes[source] and target == pytest.approx(want[source]) and n <= 2 * size
        taken[source] += n
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(32, 0.05 * target)
    assert _taken(mix_sources(docs.repartition(7), block_words=16)) == got


def test_mixed_texts_hold_what_is_taken(odd):
    mix = mix_sources(odd, block_words=16)
    want = Counter()
    for (doc, *_), (*_, n) in _taken(mix).items():
        want[doc] += n
    got = Counter()
    for r in mix.taken_texts().collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert +got == +want
    blocks = mix.blocks().collect()
    assert sum(len(words(b["text"])) for b in blocks) == sum(want.values())
    assert max(Counter((b["source_no"], b["pass"], b["block"]) for b in blocks).values()) == 1
    assert mix.counts.agg(F.sum("n")).first()[0] == len(blocks)


def test_the_mix_is_what_the_shards_drew(odd, monkeypatch):
    """Every shard has its places filled, by sources as a plain draw of tickets; what a shard drew is what is taken for it."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 100)
    monkeypatch.setattr(mixing, "SHARD_GROUP", 3)
    mix = mix_sources(odd, block_words=16)
    counts = mix.counts.collect()
    slots = {r["source_no"]: r["slots"] for r in mix.sources.collect() if r["slots"]}
    total = sum(slots.values())
    of_shard, of_source = Counter(), Counter()
    for r in sorted(counts, key=lambda r: r["shard"]):
        assert r["first"] == of_source[r["source_no"]]
        of_shard[r["shard"]] += r["n"]
        of_source[r["source_no"]] += r["n"]
    assert of_source == slots and len(of_shard) > 3
    assert [of_shard[i] for i in range(len(of_shard))] == [100] * (total // 100) + [total % 100] * (total % 100 > 0)
    # Of each shard about the sources' shares: within five deviations of the draw.
    for r in counts:
        size, share = of_shard[r["shard"]], slots[r["source_no"]] / total
        assert abs(r["n"] - size * share) <= 5 * (size * share * (1 - share)) ** 0.5 + 1
    assert mix.pieces.agg(F.sum("n_words")).first()[0] == sum(s["source_size"] for s in mix.sources.collect())
    parts = [dataclasses.replace(mix, counts=mix.counts.where(F.col("shard") % 2 == i)) for i in (0, 1)]
    taken = [Counter({tuple(r[k] for k in KEYS): r["taken"] for r in m.taken().collect()}) for m in (mix, *parts)]
    assert taken[0] == taken[1] + taken[2] and taken[1] and taken[2]
    other = mix_sources(odd, block_words=16, seed=8).counts.collect()
    assert {tuple(r) for r in other} != {tuple(r) for r in counts}


def test_joins_of_the_mix_do_not_broadcast_what_grows(odd):
    mix = mix_sources(odd, block_words=16)
    for df in (mix.taken(), mix.slots):
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(5))).collect()
        assert sorted(r[0] for r in got) == list(range(n))


def test_mix_of_nothing(nothing):
    assert mix_sources(nothing).taken_texts().count() == 0


# -- pieces ------------------------------------------------------------------------------


def test_codec_equals_the_library(spark, odd, odd_rows):
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in encode_documents(odd, MODEL).collect())
    want = Counter()
    for doc, text, _ in odd_rows:
        ids = whole.encode(text or "", add_bos=True, add_eos=True)
        want[(doc, len(ids), np.array(ids, "<u4").tobytes(), whole.decode(ids))] += 1
    assert got == want
    texts = ["", " ", "  a", "a  ", "▁", "a▁ ▁b", "\n\n x\ty", "\x00 \x01", "é\u0301 ﬁ ①", "<s> </s> <unk> <0x0A>", "a\r\nb", "😀" * 9, "日本語 テキスト", " " * 20 + "x" + " " * 17]
    rng = random.Random(4)
    texts += ["".join(rng.choice(" ▁\nabé日.") for _ in range(rng.randrange(40))) for _ in range(300)]
    codec = ChunkCodec(open(MODEL, "rb").read(), table_size=50)
    for text in texts:
        ids = whole.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == ids, repr(text)


def test_codec_of_nothing(nothing):
    assert encode_documents(nothing, MODEL).count() == 0


# -- search -------------------------------------------------------------------------------


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(400)]
    rows += [(400 + i, rows[50][1]) for i in range(20)]  # ties
    rows += [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] + [1.0] * 7), (504, [1.0, 2.0]), (550, [2.0, 1.0]), (None, rows[3][1]), (600, [float("inf")] * 8), (50, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    want = []
    asked = {q: min(x.tolist() for i, x in good if i == q) for q, _ in good if q % 50 == 0}
    for q, x in good:
        if q % 50 == 0 and x.tolist() == asked[q]:
            scores = sorted((-(x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())), i) for i, y in good if i != q and len(y) == len(x))
            want += [(q, i, -s) for s, i in scores[:5]]
    got = [tuple(r) for r in nearest(df, df.where("vec_id % 50 = 0"), block=32, blocks_per_group=3).select("query_id", "id", "score", "rank").collect()]
    once = lambda pairs: Counter((q, round(s, 9)) for q, s in pairs)
    assert once((q, s) for q, _, s, _ in got) == once((q, s) for q, _, s in want)
    assert {(q, i) for q, i, _, _ in got if q not in (50, 550)} == {(q, i) for q, i, _ in want if q not in (50, 550)}
    assert sorted(r for q, *_, r in got if q == 100) == [1, 2, 3, 4, 5]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [1024, 8192, 20000])
def test_sums_of_many_dimensions_are_exact(dim):
    """Sign vectors have products of 127 * 127 in every dimension, and many equal cosines."""
    rng = np.random.default_rng(dim)
    c = np.where(rng.random((64, dim)) < 0.5, -1.0, 1.0)
    c[8:40] = c[0]
    c[np.arange(8, 40), rng.integers(0, dim, 32)] *= -1
    q = np.where(rng.random((4, dim)) < 0.5, -1.0, 1.0)
    q[0] = c[0]
    ids = np.arange(64)
    got = search_group((np.arange(100, 104), q), [(ids, c)], 5)
    for x, heap in zip(q, got, strict=True):
        scores = (x * c).sum(axis=1) / (np.sqrt((x * x).sum()) * np.sqrt((c * c).sum(axis=1)))
        assert sorted((-s, -i) for s, i in heap) == sorted(zip((-scores).tolist(), ids.tolist(), strict=True))[:5]


def test_search_of_the_given_table(spark, sf_dir):
    got = queries.QUERIES["op9_nearest_neighbours"](spark, sf_dir).collect()
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, m = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    unit = m / np.sqrt((m * m).sum(axis=1))[:, None]
    for q in ids[ids % 50 == 0]:
        near = unit @ unit[ids == q][0]
        near[ids == q] = -2
        best = ids[np.lexsort((ids, -near))[:5]].tolist()
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == best


# -- URLs ---------------------------------------------------------------------------------


def test_urls_and_rules(spark):
    rows = [
        (1, "https://Blog.Example.COM/en/1?x"), (2, "http://www.example.com/en/1"), (3, "http://a.www.example.com/en/"), (4, "http://x.net/fr/1#top"),
        (5, "http://x.net/de/"), (6, "http://example.com"), (7, None), (8, "no scheme/en/"), (9, ""), (10, "http://notexample.com/en/"), (11, "ftp://h?q://z/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"rule": F.lit(1), "verdict": F.lit("old")})
    model = url_filter.UrlModel(np.zeros(url_filter.DIMENSIONS), -1.0)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, model).collect()}
    assert got == {
        1: ("blog.example.com", "/en/1", "example.com/en/", "block"), 2: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        3: ("a.www.example.com", "/en/", "www.example.com/en/", "allow"), 4: ("x.net", "/fr/1", "net/fr/", "block"), 5: ("x.net", "/de/", None, "allow"),
        6: ("example.com", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"),
        10: ("notexample.com", "/en/", "com/", "allow"), 11: ("h", "", None, "allow"),
    }


def test_url_model_on_held_out_rows(spark, sf_dir):
    pages = url_filter.with_rule(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")).withColumnRenamed("rule_verdict", "verdict")
    model = url_filter.train(pages.where("page_id % 2 = 0"))
    held = pages.where("page_id % 2 = 1 AND verdict IS NOT NULL").select("host", "path", "verdict").toArrow()
    said = model.blocked(held.column("host").combine_chunks(), held.column("path").combine_chunks())
    assert (said == np.array([v == "block" for v in held.column("verdict").to_pylist()])).mean() > 0.97
    assert url_filter.train(pages.limit(0)).intercept == 1.0
    assert url_filter.judge(pages.limit(0), model).count() == 0


def test_url_features_are_per_row():
    a = url_filter.features(pa.array(["abc.com", None, "abc.com"]), pa.array(["/x/y", "/q", "/x/y"]))
    assert Counter(a[0].tolist())[0] == Counter(a[0].tolist())[2]


# -- edit-aware counts -------------------------------------------------------------------------


def test_trees_follow_edits():
    cutter = edit_counts.PreTokens(open(RANKS, "rb").read())
    rng, pool = random.Random(1), ["a", "b", " ", "  ", "\n", "'", "s", "1", "é", "!", "the ", " don't"]
    for size in [5] * 300 + [400] * 40:
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(size)))
        tree = edit_counts.TokenTree(*cutter.cut(text))
        for _ in range(4):
            put = "".join(rng.choice(pool) for _ in range(rng.randrange(6)))
            text, _ = tree.edit(text, rng.randrange(len(text) + 2), rng.randrange(7), put, cutter)
            assert tree.n_tokens == len(cutter.encoding.encode_ordinary(text))
            assert [n for leaf in tree.leaves for n in leaf[0]] == cutter.cut(text)[0]


def test_edits_over_rows(odd, odd_rows):
    cutter = edit_counts.PreTokens(open(RANKS, "rb").read())
    trees = edit_counts.build_trees(odd, RANKS)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in trees.collect()) == Counter((d, len(cutter.encoding.encode_ordinary(t or ""))) for d, t, _ in odd_rows)
    edited = edit_counts.apply_edits(trees.withColumn("edits", edit_counts.drawn_edits(F.col("text"), F.col("doc_id"))), RANKS).collect()
    assert len(edited) == len(odd_rows)
    for r in edited:
        assert r["n_tokens"] == len(cutter.encoding.encode_ordinary(r["text"]))
        lengths, counts = cutter.cut(r["text"])
        assert np.frombuffer(r["tree_lengths"], "<u4").tolist() == lengths and np.frombuffer(r["tree_counts"], "<u4").tolist() == counts
        if len(r["text"]) > 5000 and " " in r["text"]:
            assert r["n_matched"] < 600
    no_edits = edit_counts.apply_edits(trees.withColumn("edits", F.lit(None).cast("array<struct<at:int,length:int,put:string>>")), RANKS)
    assert no_edits.where("n_matched > 0").isEmpty()


def test_counts_of_nothing(nothing):
    assert edit_counts.build_trees(nothing, RANKS).count() == 0
