"""Repeated byte strings, periodic runs of words and the filter audit, each against brute force or its SQL."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from tallyspark.llm import common, filter_audit, suffix_dedup, word_runs

from .test_operators import SF, empty, odd


def by_duck(sql, folder=SF, **tables):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        if name in tables:
            con.register(name, tables[name].toPandas() if hasattr(tables[name], "toPandas") else tables[name])
        else:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=repr)


def of_spark(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


# --- suffix dedup ------------------------------------------------------------------------------------------------------


def removed_by_hand(texts, length=200):
    """(bytes removed, runs, hash of what is left) of each text."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(t), sum(gone), sum(a and not b for a, b in zip(gone, b"\0" + gone)), hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_suffix_dedup_against_sql(spark):
    got = suffix_dedup.op11_suffix_array_dedup(spark, SF)
    assert of_spark(got) == by_duck(suffix_dedup.OP11_SQL)


def made_texts(seed, n=60):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdeé日", k=draw.randint(1, 7))) for _ in range(200)]
    passages = [" ".join(draw.choices(words, k=60)) for _ in range(4)]
    out = []
    for _ in range(n):
        t = " ".join(draw.choices(words, k=draw.randint(0, 80)))
        for _ in range(draw.randint(0, 2)):
            p = draw.choice(passages)
            k = draw.randrange(len(p))
            t += draw.choice([p, p[:k] + "X" + p[k + 1 :], p[k:], "ab" * draw.randint(50, 200), "z" * draw.randint(0, 400)])
        out.append(t)
    return [*out, *out[:5], None, "", "x" * 199, "x" * 200]


@pytest.mark.parametrize("most", [5000, 1])
def test_suffix_dedup_by_hand(spark, most):
    texts = made_texts(most)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, most=most).collect()}
    want = removed_by_hand([(t or "").encode() for t in texts])
    assert len(rows) == len(texts)
    for i, (n, gone, runs, left) in enumerate(want):
        spans = [(s.a, s.b) for s in rows[i].spans]
        assert (len(rows[i].kept) + sum(b - a for a, b in spans), sum(b - a for a, b in spans), len(spans), hashlib.sha256(rows[i].kept).hexdigest()) == (n, gone, runs, left)
    assert any(0 < gone < n for n, gone, _, _ in want)


def test_merged_order_and_prefixes():
    draw = random.Random(3)
    texts = [bytes(draw.choices(b"ab", k=draw.randint(200, 300))) for _ in range(9)]
    texts[4] = texts[1][30:] + texts[2]
    for shard in (1, 250, 700, 10**6):
        rows, prefix, begins = suffix_dedup.merged_intervals(texts, shard=shard)
        assert sorted(rows.tolist()) == list(range(sum(map(len, texts))))
        owner = np.searchsorted(begins, rows, side="right") - 1
        tails = [texts[o][r - begins[o] :][:200] for o, r in zip(owner, rows)]
        whole = [i for i, t in enumerate(tails) if len(t) == 200]
        assert [tails[i] for i in whole] == sorted(tails[i] for i in whole)
        for i, j in zip(whole, whole[1:]):
            same = next((k for k, (x, y) in enumerate(zip(tails[i], tails[j])) if x != y), 200)
            assert min(prefix[i + 1 : j + 1]) == (same if same == 200 else (same + 8) // 16 * 16 - 8 if same >= 8 else 0)


def test_repeated_windows_random():
    draw = random.Random(1)
    for trial in range(30):
        base = [bytes(draw.choices(b"ab" if trial % 3 else b"a", k=300)) for _ in range(3)]
        texts = []
        for _ in range(draw.randint(1, 12)):
            t = bytearray(draw.choice(base))
            t[draw.randrange(len(t))] = draw.randrange(256)
            a = draw.randrange(60)
            texts.append(bytes(t[a : a + draw.randint(200, 240)]))
        count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
        got = suffix_dedup.repeated_windows(texts, np.ones(len(texts), int), shard=draw.choice([1, 300, 700, 10**6]))
        assert [g.tolist() for g in got] == [[count[t[i : i + 200]] > 1 for i in range(len(t) - 199)] for t in texts]


def test_pieces_hold_every_window_once():
    draw = random.Random(2)
    texts = [b"", b"a" * 199, b"a" * 2000, bytes(draw.choices(b"abc", k=5000)), b"abc" * 700]
    for part in (300, 10**6):
        doc, start, windows, anchor, value = suffix_dedup.pieces_of(texts, part=part)
        places = sorted((d, s + i) for d, s, w in zip(doc.tolist(), start.tolist(), windows.tolist()) for i in range(w))
        assert places == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - 199)]
        kinds = {}
        for d, s, w, a, v in zip(doc.tolist(), start.tolist(), windows.tolist(), anchor.tolist(), value.tolist()):
            assert kinds.setdefault((a, v), texts[d][s : s + w + 199]) == texts[d][s : s + w + 199]
            inside = [texts[d][s + i : s + i + 200] for i in range(w)]
            assert len(set(inside)) == len(inside)
        assert len(set(kinds.values())) == len(kinds)


def test_suffix_dedup_odd(spark):
    df = odd(spark)
    rows = [(r.doc_id, r.kept, len(r.spans)) for r in suffix_dedup.remove_repeats(df).collect()]
    assert len(rows) == df.count()
    assert sorted(n for _, _, n in rows) == [0] * 9 + [1]  # the long text repeats in itself, all of it
    assert [k for d, k, _ in rows if d == 5] == [b""]
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    same = spark.createDataFrame([(None, "y" * 250), (None, "y" * 250), (3, "y" * 200 + "é" * 150)], "doc_id long, text string")
    assert sorted(bytes(r.kept).decode() for r in suffix_dedup.remove_repeats(same).collect()) == ["", "", ""]
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(df, length=201)


# --- runs of words -----------------------------------------------------------------------------------------------------


def runs_by_hand(words):
    ids = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words], int)
    out, seen = [], set()
    for q in range(1, len(x) // 3 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(int), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            n = b - a + q
            if n >= max(24, 3 * q) and (a, n) not in seen:  # by rising period: the smallest comes first
                out.append((a, n, q))
                seen.add((a, n))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(draw):
    vocabulary = [f"w{i}" for i in range(draw.choice([1, 2, 3, 5, 50]))]
    out = []
    for _ in range(draw.randint(0, 8)):
        if draw.random() < 0.4:
            out += draw.choices(vocabulary, k=draw.randint(1, 60))
        else:
            unit = draw.choices(vocabulary, k=draw.randint(1, draw.choice([2, 6, 40])))
            if draw.random() < 0.3:
                unit = unit * draw.randint(2, 4) + draw.choices(vocabulary, k=2)
            out += (unit * draw.randint(2, 9))[: draw.randint(1, 400)]
    return out


def test_runs_random():
    draw = random.Random(5)
    for _ in range(150):
        texts = [periodic_words(draw) for _ in range(draw.randint(1, 8))]
        assert [[tuple(r) for r in g.tolist()] for g in word_runs.runs_of(texts)] == [runs_by_hand(t) for t in texts]
    a, b = ["a"], ["b"]
    for _ in range(14):
        a, b = a + b, a
    assert [tuple(r) for r in word_runs.runs_of([a])[0].tolist()] == runs_by_hand(a)


def digest_by_hand(doc_id, text, plant=True):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_op12_by_hand(spark):
    rows = common.table(spark, SF, "documents").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in word_runs.op12_periodic_runs(spark, SF).collect())
    assert got == sorted(digest_by_hand(r.doc_id, r.text) for r in rows)
    assert sum(r[1] > 0 for r in got) > len(got) / 20


def test_runs_odd(spark):
    df = odd(spark)
    got = sorted((tuple(r) for r in word_runs.digest_runs(df).collect()), key=repr)
    assert got == sorted((digest_by_hand(r.doc_id, r.text) for r in df.collect()), key=repr)
    assert word_runs.digest_runs(empty(spark)).count() == 0
    found = {r.doc_id: r for r in word_runs.find_runs(df.where("doc_id in (3, 5)")).collect()}
    assert found[3].runs == [] and found[3].collapsed == ""
    assert [tuple(x) for x in found[5].runs] == [(0, 30_000, 10)] and found[5].collapsed.split() == "one two three four five six seven eight nine ten".split()


def test_grammar_derives_the_text():
    """Each nonterminal stands for the same words at all its places, and every pair of sizes adds up."""
    draw = random.Random(8)
    x = np.array((draw.choices(range(4), k=30) * 5)[:140] + draw.choices(range(9), k=60))
    g = word_runs._Grammar(x, np.zeros(len(x), int))
    for k in range(g.nodes):
        places = g.place[g.node == k].tolist()
        assert len({tuple(x[p : p + g.size[k]].tolist()) for p in places}) == 1 and 0 < g.left[k] < g.size[k]
    assert g.size.max() == len(x)


# --- filter audit ------------------------------------------------------------------------------------------------------


def test_filter_audit_against_sql(spark):
    got = filter_audit.op13_filter_audit(spark, SF)
    assert of_spark(got) == by_duck(filter_audit.OP13_SQL)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 17, 1000, 6561])
def test_positional_popcounts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert filter_audit.positional_popcounts(words).tolist() == [int(((words >> b) & 1).sum()) for b in range(32)]


def audit_by_hand(docs, labels):
    texts, first = [(d, x or "", lang or "") for d, x, lang in docs], {}
    for d, x, _ in texts:
        if d is not None:
            first[x] = min(d, first.get(x, d))
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    fails = []
    for d, x, part in texts:
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in x).split(" ") if w]
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in x) > 3 * len(x)) + "D" * any(c in "#$%&*|" for c in x)
        fails.append((part, f + "E" * (d is not None and d > first[x]), d))
    out = []
    for part in {p for p, _, _ in fails}:
        own = [(f, d) for p, f, d in fails if p == part]
        rows, worth = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                hit = [(f, d) for f, d in left if x in f]
                left = [(f, d) for f, d in left if x not in f]
                worth[x] += len(hit)
                every = sum(x in f for f, _ in own)
                rows.append([x, order, step, len(left), len(hit), every - len(hit), sum(f == x for f, _ in own), sum(d in good for _, d in hit), sum(d in toxic for _, d in hit)])
        out += [(part, *r[1:], worth[r[0]]) for r in rows]
    return sorted(out)


def test_filter_audit_by_hand(spark):
    draw = random.Random(4)
    long = " ".join(f"w{i}" for i in range(220))
    texts = [None, "", "a b c", long, long + " |", long.upper(), "a " * 300, "A$ " * 250, long + " x", "é " * 210]
    docs = [(draw.choice([None, *range(40)]), draw.choice(texts), draw.choice([None, "", "en", "de"])) for _ in range(150)]
    labels = [(draw.choice([None, *range(40)]), draw.choice([None, 0, 1]), draw.choice([None, 0, 1])) for _ in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as part", "2 as mask", "3 as good", "4 as toxic", "5 as id", "6 as known")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = sorted(tuple(r) for r in filter_audit.audit(frame, told).select(*names).collect())
    assert got == audit_by_hand(docs, [x for x in labels if x[0] is not None])


def test_filter_audit_odd(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty(spark), labels).count() == 0
    df = odd(spark)
    got = filter_audit.audit(df, labels)
    assert got.count() == 600
    assert {r.kept + r.removed for r in got.where("step = 1").collect()} == {df.count()}
    assert got.where("good_lost != 0 or toxic_lost != 0").isEmpty()
    counted = filter_audit.survivors(filter_audit.failures(df.withColumn("lang", df.source), labels), most=0).collect()
    assert [r.every[0] for r in counted] == [df.count()]
