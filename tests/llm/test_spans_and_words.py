"""Spelling forms, personal data and the source audit against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewright.llm import personal_data, queries, source_audit, spelling_forms
from pricewright.llm.packed_terms import counted, runs_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- packed terms -----------------------------------------------------------------------


@pytest.mark.parametrize("lengths", [(1, 8), (7, 18), (15, 40), (1, 400)])
def test_packed_counts(lengths):
    rng = random.Random(str(lengths))
    pool = ["".join(rng.choice("abé𝄞z") for _ in range(rng.randint(*lengths))) for _ in range(60)]
    pool += [w + "a" for w in pool[:20]] + [w[:-1] for w in pool[:20] if len(w) > 1]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(50)]
    group = [rng.randrange(3) for _ in texts]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *[len(t.encode()) for t in texts]])
    starts, ends, of = runs_of(raw != 0x20, bounds)
    got = Counter()
    for c in counted(raw, starts, ends, of, np.array(group)[of]):
        words = c.long or [(int(h).to_bytes(8, "big") + int(l).to_bytes(8, "big")).rstrip(b"\0") for h, l in zip(c.high, c.low)]
        for g, w, n, d in zip(c.group, words, c.n, c.n_texts):
            got[int(g), w.decode(), int(n), int(d)] += 1
    n, docs = Counter(), defaultdict(set)
    for i, (t, g) in enumerate(zip(texts, group)):
        for w in t.split():
            n[g, w] += 1
            docs[g, w].add(i)
    assert got == Counter({(*k, v, len(docs[k])): 1 for k, v in n.items()})


# -- source audit ------------------------------------------------------------------------


def plain_audit(rows, min_docs=3, top=200):
    """``rows`` are (text, lang, source); every share of every kept term, in whole numbers."""
    n, docs, sources = defaultdict(Counter), defaultdict(set), defaultdict(set)
    for i, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)):
            n[lang, source][term] += 1
            docs[lang, term].add(i)
    out = []
    for lang, names in sources.items():
        kept = sorted(t for (l, t), d in docs.items() if l == lang and len(d) >= min_docs)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        every = Counter()
        for s in names:
            every.update(n[lang, s])
        q, p = shares(every), {s: shares(n[lang, s]) for s in names}
        for s in names:
            pair = {o: sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in names - {s}}
            term = {t: (p[s][t] - q[t]) ** 2 // q[t] for t in kept if n[lang, s][t] and p[s][t] > q[t]}
            for part, values, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(ranked)]
    return Counter(out)


def test_audit_equals_plain_version(spark, odd_rows):
    rng = random.Random(5)
    vocabulary = ["river", "stone", "Ärger", "überlangesWortausvielenBuchstaben", "éé", "x", "abcdefgh", "abcdefghi", "x" * 700]
    rows = [(t, rng.choice(["en", None, "de"]), s) for _, t, s in odd_rows]
    for _ in range(150):
        weights = [rng.random() ** 3 for _ in vocabulary]
        rows.append((" ".join(rng.choices(vocabulary, weights, k=rng.randrange(30))), rng.choice(["en", "de"]), rng.choice("abcdef")))
    rows += [("only here 12", "fr", "a"), (None, "fr", "b"), ("", "it", None)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "text string, lang string, source string, part string, rank int")
    assert Counter(map(tuple, source_audit.audit(df).collect())) == plain_audit(rows)
    assert Counter(map(tuple, source_audit.audit(df, top=2).collect())) == plain_audit(rows, top=2)


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert source_audit.audit(empty).collect() == []
    one = spark.createDataFrame([("a b c", "en", "s")], empty.schema)
    assert source_audit.audit(one).collect() == []


# -- spelling forms ------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_vocabulary(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 3}


def plain_forms(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = Counter()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None] += 1
    return out


def small_words(rng, how_many):
    base = ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "ababababa", "ébène", "ébènes", "a" * 40, "a" * 41]
    return base + ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(how_many)]


@pytest.mark.parametrize("hot", [3, 50_000])
def test_near_words(spark, hot):
    words = sorted(set(small_words(random.Random(7), 400)))
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = Counter((r["word"], r["near"]) for r in spelling_forms.near_words(df, hot).collect())
    assert got == Counter((a, b) for a in words for b in words if one_edit(a, b))


def test_forms_equal_plain_version(spark, odd_rows):
    rng = random.Random(11)
    words = small_words(rng, 150) + ["Straße", "l'heure", "x×y÷zzzz", "ŒUVRE", "ABCDEF"]
    weights = [rng.random() ** 4 for _ in words]
    rows = [(i if i % 9 else None, " ".join(rng.choices(words, weights, k=60))) for i in range(250)] + [(d, t) for d, t, _ in odd_rows]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, word string, n int")
    n = plain_vocabulary(rows)
    assert any(len(w) == 40 for w in n) and len(n) > 100
    assert Counter(map(tuple, spelling_forms.group_spellings(df).collect())) == plain_forms(n)
    assert spelling_forms.group_spellings(df.limit(0)).collect() == []


def test_long_chains_and_runs(spark):
    """A chain of forms as long as counts allow, and runs of many thousand letters."""
    chain = [("a" * (6 + i), 3 * 2**i) for i in range(20)]
    forms = spark.createDataFrame([(w, chain[i + 1][0]) for i, (w, _) in enumerate(chain[:-1])], "word string, form string")
    assert {r["root"] for r in spelling_forms.roots_of(forms).collect()} == {chain[-1][0]}
    long = "".join(random.Random(1).choice("abcdef") for _ in range(20_000))
    rows = [(i, f"{long} {long[:-1]} {long[1:]} {long[:777]}z{long[778:]}") for i in range(4)]
    n = plain_vocabulary(rows)
    got = spelling_forms.group_spellings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == plain_forms(n)


# -- personal data ---------------------------------------------------------------------------


def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1]))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(personal_data.KINDS[k], s, e) for s, k, e in sorted(out)]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(13)
    for alphabet in ("1a@.", "012+-() .", "4 -5", "25.0", "ab1@.-_+ é٣", "0123456789 "):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert personal_data.base_spans(text) == plain_base(text), text
            good, more = personal_data.candidates(text)
            assert good == plain_base(text)
            for _, s, e in more:
                assert s < e and all(e <= a or b <= s for _, a, b in good)


def test_long_texts_take_linear_time():
    for text in ("1" * 400_000, "1." * 200_000, "a" * 400_000, "a@" * 200_000, "+1 " * 130_000, "1 " * 200_000, "(at)" * 100_000):
        personal_data.candidates(text)


def test_reliabilities_find_the_labelers():
    rng = np.random.default_rng(3)
    truth = rng.random(40_000) < 0.3
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.6])
    cast = np.where(rng.random((len(truth), 6)) < right, np.where(truth[:, None], 1, 2), np.where(truth[:, None], 2, 1))
    cast[rng.random(cast.shape) < 0.2] = 0
    patterns, at, counts = np.unique(cast @ 3 ** np.arange(6), return_inverse=True, return_counts=True)
    likely, chances = personal_data.reliabilities(patterns, counts.astype(float))
    assert ((likely[at] >= 0.5) == truth).mean() > 0.97
    assert np.abs(chances[1, :, personal_data.YES] - right).max() < 0.03


def labelled_documents():
    """Documents with signed and unsigned phone numbers that are called for, and other numbers of that shape."""
    rng, rows, wanted = random.Random(17), [], {}
    for i in range(400):
        number = f"{rng.randrange(200, 999)}-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
        kind = i % 4
        word, sign = [("call", "+1 "), ("phone", ""), ("order", ""), ("tel", "+44 ")][kind]
        text = f"some words then {word} {'#' if kind == 2 else ''}{sign}{number} and {'more' if kind == 2 else 'ask'} words"
        rows.append((i, text))
        start = text.index(sign + number)
        wanted[i] = None if kind == 2 else f"phone:{start}:{start + len(sign + number)}"
    return rows, wanted


def test_added_spans(spark):
    rows, wanted = labelled_documents()
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, spans string, n_card int")
    model = personal_data.train(df)
    got = {r["doc_id"]: r for r in personal_data.find_personal_data(df, model).collect()}
    right = sum((got[i]["spans"] or None) == w for i, w in wanted.items())
    assert right >= 0.95 * len(rows)
    for i, text in rows:
        base = plain_base(text)
        assert got[i]["base"] == ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert set(got[i]["base"].split(",")) <= set(got[i]["spans"].split(",")) or not base
        assert all(got[i][f"n_{kind}"] == sum(k == kind for k, _, _ in base) for kind in personal_data.KINDS)


def test_odd_rows_and_the_query(spark, sf_dir, odd, odd_rows):
    model = personal_data.train(odd)
    found = personal_data.find_personal_data(odd, model)
    assert found.columns[: len(odd.columns) - 1] == [c for c in odd.columns if c != "text"]
    assert Counter((r["doc_id"], r["base"]) for r in found.collect()) == Counter((d, ",".join(f"{k}:{s}:{e}" for k, s, e in plain_base(t or ""))) for d, t, _ in odd_rows)
    nothing = odd.limit(0)
    assert personal_data.find_personal_data(nothing, personal_data.train(nothing)).collect() == []
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op12_personal_data(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        base = plain_base(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(b[0] == k for b in base) for k in personal_data.KINDS]
        spans = [x for x in r["spans"].split(",") if x]
        assert len(spans) == len(base) + r["n_added"] and set(joined.split(",")) - {""} <= set(spans)
        assert spans == sorted(spans, key=lambda x: (int(x.split(":")[1]), personal_data.KINDS.index(x.split(":")[0])))
