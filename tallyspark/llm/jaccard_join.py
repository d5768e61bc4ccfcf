"""N-gram Jaccard join: documents whose sets of word 5-shingles are at least 75 % alike, and their components.

Documents with equal shingle sets are one node, named by a hash of the set. Two sets of n shingles link only if they
share T = ceil(0.75 n) of each; the search narrows down in steps that each keep every link:

1. Count filter. Of each set, its smallest hashes (a prefix) go into inverted lists; a node that doesn't share enough of them with
   any other can't link. Postings travel packed, many in a row, by shingle; a list's length comes back to its nodes.
   Shingles of very many documents are found beforehand and aren't posted: they count as shared.
2. The same over the whole sets of what is left: nodes that share fewer than T shingles go.
3. Shingles are ordered by the length of their lists. Two linked sets share one of the n - T + 1 first in this order, so the lists of
   those hold all links. The list's most central node is compared with the others first; components
   of the links found say which lists are done. In the rest, nodes of different components whose sizes and places allow a link
   are compared, long lists in blocks.
4. Comparing a node with a block of others is a T-occurrence search (DivideSkip): inverted lists over the block, the
   longest ones set aside, a heap merge of the short ones for nodes that can still reach T, binary probes into the long ones.

No group of a shuffle is collected but blocks of bounded size and packed postings of a hash range, whose number grows
with the corpus. Hashes are 64 bits.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, A-Z lower-cased. Fewer
than five words: the whole sequence is the one shingle. Null and empty texts, and those without words: no shingle, no
link, a component of their own. Rows with equal doc_id and text are one document and all get its result; a null doc_id links with
nothing and has a null component. Empty tables give no rows. Extra columns are not read; ``keep_one`` hands them on.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common
from tallyspark.operators.components import connected_components

WORDS, PERCENT = 5, 75
#: Share of a set, in percent, by which the first filter's prefix is longer than the shortest one possible.
MORE = 15
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of them."""
    if len(_powers["up"]) < n:
        n = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            a = np.full(n, b, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def word_hashes(text: str, block: int = 1 << 20) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # in blocks of whole words, so that the temporary arrays stay small
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block, side="right")))
        first, last = int(starts[at]), int(ends[to - 1])
        part = data[first:last].astype(np.uint64)
        part += np.where((part >= 65) & (part <= 90), np.uint64(32), np.uint64(0))
        up, down = _power(len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part + np.uint64(1)) * up[: len(part)], dtype=np.uint64)])
        a, b = starts[at:to] - first, ends[at:to] - first
        out[at:to] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes, rising."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        h = mixed(h * _BASE + w[j : len(w) - k + 1 + j])
    return np.unique(h)


def signature(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_shared(n):
    """What a set of n must share with any set it links with."""
    return -(-PERCENT * n // 100)


def enough(shared: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m that share so many are alike enough."""
    return 100 * shared >= PERCENT * (n + m - shared)


# --- packed postings -----------------------------------------------------------------------------------------------

POSTINGS = "bucket int, known boolean, sigs binary, sizes binary, counts binary, hashes binary"


def _packed(sets: dict[int, tuple[int, np.ndarray]], buckets: int, heavy: np.ndarray) -> Iterator[pd.DataFrame]:
    """Postings of some sets, dealt into buckets by shingle; shingles in heavy into buckets by set."""
    if not sets:
        return
    sigs = np.fromiter(sets, np.int64, len(sets))
    sizes = np.array([n for n, _ in sets.values()], np.int32)
    owner = np.repeat(np.arange(len(sigs)), [len(h) for _, h in sets.values()])
    hashes = np.concatenate([h for _, h in sets.values()])
    known = np.isin(hashes, heavy) if len(heavy) else np.zeros(len(hashes), bool)
    rows = []
    for kind in (False, True):
        h, o = hashes[known == kind], owner[known == kind]
        bucket = ((h if not kind else mixed(sigs.view(np.uint64))[o]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        h, o, bucket = h[order], o[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(h)]
        for a, b in zip(cuts, cuts[1:]):
            first = a + np.flatnonzero(np.diff(o[a:b], prepend=-1))
            rows.append((int(bucket[a]), kind, sigs[o[first]].tobytes(), sizes[o[first]].tobytes(), np.diff(np.append(first, b)).astype(np.int32).tobytes(), h[a:b].tobytes()))
    yield pd.DataFrame(rows, columns=["bucket", "known", "sigs", "sizes", "counts", "hashes"])


def _opened(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, sig of each, size of each), each pair of hash and sig once, by hash."""
    join = lambda c, t: np.frombuffer(b"".join(rows[c]), t)
    counts = join("counts", np.int32)
    h, s, n = join("hashes", np.uint64), np.repeat(join("sigs", np.int64), counts), np.repeat(join("sizes", np.int32), counts)
    order = np.lexsort((s, h))
    h, s, n = h[order], s[order], n[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    return h[new], s[new], n[new]


SHARED = "slab int, sigs binary, sizes binary, counts binary, hashes binary, lengths binary"


def _shared(postings: DataFrame, slabs: int, heavy: dict[int, int], with_hashes: bool) -> DataFrame:
    """Of each bucket the postings whose shingle at least two nodes have, dealt into slabs by node."""
    heavy_h = np.array(sorted(heavy), np.uint64)
    heavy_n = np.array([heavy[int(h)] for h in heavy_h], np.int64)

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for kind in (False, True):
            some = rows[rows["known"] == kind]
            if not len(some):
                continue
            h, s, n = _opened(some)
            if kind:
                length = heavy_n[np.searchsorted(heavy_h, h)]
            else:
                starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                length = np.repeat(np.diff(np.append(starts, len(h))), np.diff(np.append(starts, len(h))))
                h, s, n, length = h[length > 1], s[length > 1], n[length > 1], length[length > 1]
            parts.append((h, s, n, length))
        h, s, n, length = (np.concatenate(x) for x in zip(*parts))
        slab = (mixed(s.view(np.uint64)) % np.uint64(slabs)).astype(np.int64)
        order = np.lexsort((s, slab))
        h, s, n, length, slab = h[order], s[order], n[order], length[order], slab[order]
        cuts, out = np.flatnonzero(np.diff(slab, prepend=-1)).tolist() + [len(h)], []
        for a, b in zip(cuts, cuts[1:]):
            first = a + np.flatnonzero(np.concatenate([[True], s[a + 1 : b] != s[a : b - 1]]))
            out.append((int(slab[a]), s[first].tobytes(), n[first].tobytes(), np.diff(np.append(first, b)).astype(np.int32).tobytes(), h[a:b].tobytes() if with_hashes else b"", length[a:b].astype(np.int32).tobytes() if with_hashes else b""))
        return pd.DataFrame(out, columns=["slab", "sigs", "sizes", "counts", "hashes", "lengths"])

    return postings.groupBy("bucket").applyInPandas(reduce, SHARED)


# --- T-occurrence search -------------------------------------------------------------------------------------------


def divide_skip(probe: np.ndarray, sets: list[np.ndarray], mu: float = 0.02) -> np.ndarray:
    """Which of the sets link with the probe.

    T is the least overlap that any of them needs. Of the inverted lists, the L longest are set aside (L as in the
    published heuristic, below T); a heap merge of the others finds the sets met at least T - L times, the long lists
    are probed for those by binary search, and sets that reach their own required overlap stay.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(sets), bool)
    able = np.flatnonzero((sizes >= least_shared(len(probe))) & (least_shared(sizes) <= len(probe)))
    if not len(able) or not len(probe):
        return out
    needed = -(-PERCENT * (len(probe) + sizes[able]) // (100 + PERCENT))
    t = int(needed.min())
    tokens, who = np.concatenate([sets[i] for i in able]), np.repeat(np.arange(len(able)), sizes[able])
    place = np.minimum(np.searchsorted(probe, tokens), len(probe) - 1)
    hit = probe[place] == tokens
    place, who = place[hit], who[hit]
    order = np.lexsort((who, place))
    place, who = place[order], who[order]
    cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    lists = sorted((who[a:b] for a, b in zip(cuts, np.append(cuts[1:], len(who)))), key=len, reverse=True)
    if len(lists) < t:
        return out
    n_long = min(t - 1, int(t / (mu * np.log2(max(2, len(lists[0]))) + 1)))
    long, short = lists[:n_long], lists[n_long:]
    heap = [(int(x[0]), k, 0) for k, x in enumerate(short)]
    heapq.heapify(heap)
    found, counts = [], []
    while heap:
        top, times = heap[0][0], 0
        while heap and heap[0][0] == top:
            _, k, i = heap[0]
            times += 1
            if i + 1 < len(short[k]):
                heapq.heapreplace(heap, (int(short[k][i + 1]), k, i + 1))
            else:
                heapq.heappop(heap)
        if times >= t - n_long:
            found.append(top)
            counts.append(times)
    if not found:
        return out
    candidates, overlap = np.array(found), np.array(counts)
    for x in long:
        at = np.minimum(np.searchsorted(x, candidates), len(x) - 1)
        overlap += x[at] == candidates
    good = enough(overlap, len(probe), sizes[able][candidates])
    out[able[candidates[good]]] = True
    return out


def _compare(pairs: DataFrame, sets: DataFrame, block: int = 128) -> DataFrame:
    """(probe, target) -> the pairs of them that link, as (src, dst). Probes with many targets are met in several blocks."""
    pairs = common.stored(pairs)
    many = pairs.groupBy("probe").agg(F.count("*").alias("n"))
    salts = many.select("probe", F.ceil(F.col("n") / block).cast("int").alias("salts"))
    salted = pairs.join(salts, "probe").select("probe", "target", F.pmod(F.xxhash64("target", "probe"), F.col("salts")).cast("int").alias("salt"))
    targets = salted.join(sets, salted["target"] == sets["sig"]).select("probe", "salt", F.lit(1).alias("role"), "sig", "hashes")
    spread = salts.select("probe", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    probes = spread.join(sets, spread["probe"] == sets["sig"]).select("probe", "salt", F.lit(0).alias("role"), "sig", "hashes")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, mine, names, others = None, None, [], []

        def done() -> pd.DataFrame:
            ok = divide_skip(mine, others)
            return pd.DataFrame({"src": np.full(int(ok.sum()), key[0], np.int64), "dst": np.array(names, np.int64)[ok]})

        for batch in batches:
            out = []
            for p, salt, role, sig, data in zip(batch["probe"].tolist(), batch["salt"].tolist(), batch["role"].tolist(), batch["sig"].tolist(), batch["hashes"].tolist()):
                if (p, salt) != key:
                    if names:
                        out.append(done())
                    key, mine, names, others = (p, salt), None, [], []
                if role == 0:
                    mine = np.frombuffer(data, np.uint64)
                elif not names or names[-1] != sig:
                    names.append(sig)
                    others.append(np.frombuffer(data, np.uint64))
            if out:
                yield pd.concat(out)
        if names:
            yield done()

    rows = probes.unionByName(targets).repartition("probe", "salt").sortWithinPartitions("probe", "salt", "role", "sig")
    return rows.mapInPandas(search, "src long, dst long")


# --- the join ------------------------------------------------------------------------------------------------------


def _sets_of(batches: Iterator[pd.DataFrame], tokens: int = 2_000_000) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """(doc_id, sig, set) of the documents with shingles, some at a time."""
    held, n = [], 0
    for batch in batches:
        for key, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
            s = shingle_set(text)
            if len(s):
                held.append((int(key), signature(s), s))
                n += len(s)
                if n >= tokens:
                    yield held
                    held, n = [], 0
    if held:
        yield held


def document_sets(docs: DataFrame, heavy_share: int = 400) -> DataFrame:
    """doc_id, n_shingles, sig (null without shingles), text_hash; beside them, with a null doc_id, shingles that many documents of a
    batch have (sig: the shingle, n_shingles: in how many)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch["text"]]
            sigs = [signature(s) if len(s) else None for s in sets]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets], "sig": pd.array(sigs, "Int64"), "many": False, "text_hash": batch["text_hash"]})
            distinct = dict(zip(sigs, sets))
            distinct.pop(None, None)
            if len(distinct) > 1:
                h, n = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
                often = n >= max(2, len(distinct) / heavy_share)
                yield pd.DataFrame({"doc_id": pd.array([None] * int(often.sum()), "Int64"), "n_shingles": n[often], "sig": pd.array(h[often].view(np.int64), "Int64"), "many": True, "text_hash": 0})

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInPandas(each, "doc_id long, n_shingles long, sig long, many boolean, text_hash long")


def pairs_within_lists(rows: DataFrame, sizes: DataFrame, block: int = 2000) -> DataFrame:
    """(probe, target) of nodes in one list that can link, as far as sizes and places tell, each pair once. rows: token, sig, n, place, component; sizes: token, size.

    From its place on a node has r shingles, so its partner has at most r * 175 / 75 - n of them, and at least 75 % of n. The smaller
    of two nodes stands in the band of its size, the larger looks into the bands that it can link with, so nodes that can't link
    don't meet. A list of more than ``block`` nodes is dealt into a grid of such blocks, each a join key of its own.
    """
    n = F.col("n")
    most = F.floor((n - F.col("place")) * (100 + PERCENT) / PERCENT) - n
    least = F.ceil(n * PERCENT / 100)
    band = lambda x: F.floor(F.log(x.cast("double")) / float(np.log(1.03))).cast("int")
    rows = rows.join(sizes, "token").withColumn("most", most).withColumn("least", least).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    own, every = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    larger = rows.where("most >= least").withColumn("band", F.explode(F.sequence(band(F.col("least")), band(F.least("n", "most")))))
    larger = larger.withColumn("i", own).withColumn("j", every).select("token", "band", "i", "j", "sig", "n", "least", "most", "component")
    smaller = rows.where("most >= n").withColumn("band", band(n)).withColumn("j", own).withColumn("i", every)
    smaller = smaller.select("token", "band", "i", "j", *(F.col(c).alias(f"{c}2") for c in ("sig", "n", "most", "component")))
    met = larger.join(smaller, ["token", "band", "i", "j"]).where("component != component2 and n2 between least and most and n <= most2 and (n2 < n or (n2 = n and sig2 < sig))")
    return met.select(F.least("sig", "sig2").alias("probe"), F.greatest("sig", "sig2").alias("target")).distinct()


def links(docs: DataFrame, documents: DataFrame, heavy: dict[int, int], most_bits: int = 28, rounds: int = 2) -> DataFrame:
    """Links between nodes that join every component: (src, dst). documents: doc_id, n_shingles, sig."""
    total = documents.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = slabs = max(64, total // 2_000_000)  # of some megabytes each
    heavy_h = np.array(sorted(heavy), np.uint64)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _sets_of(batches):
            yield from _packed({sig: (len(s), s[: len(s) - least_shared(len(s)) + max(1, MORE * len(s) // 100)]) for _, sig, s in some}, buckets, heavy_h)

    def able(rows: pd.DataFrame) -> pd.DataFrame:
        join = lambda c, t: np.frombuffer(b"".join(rows[c]), t)
        sigs, first, where = np.unique(join("sigs", np.int64), return_index=True, return_inverse=True)
        n = join("sizes", np.int32)[first].astype(np.int64)
        shared = np.bincount(where, join("counts", np.int32), len(sigs))
        ok = shared >= np.maximum(1, MORE * least_shared(n) // 100)
        return pd.DataFrame({"sig": sigs[ok]})

    postings = docs.mapInPandas(prefixes, POSTINGS)
    left = _shared(postings, slabs, heavy, False).groupBy("slab").applyInPandas(able, "sig long")
    owners = documents.groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    # of each node left, the one document that hands on its set: a bit map, 16 bits a node but at most 32 MB, that lets few others
    # through; beyond some 10^8 nodes it lets more through, which then go by the counts below, and loses none
    left = common.stored(owners.join(left, "sig").select("sig", "doc_id"))
    bits = min(most_bits, max(16, (16 * left.count()).bit_length()))
    mark = left.select(F.col("sig").bitwiseXOR(F.col("doc_id")).bitwiseAND(F.lit((1 << bits) - 1)).alias("b"))
    words = mark.select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64).view(np.uint64)
    marks = docs.sparkSession.sparkContext.broadcast(bitmap)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = marks.value
        for some in _sets_of(batches):
            at = [(sig ^ key) & ((1 << bits) - 1) for key, sig, _ in some]
            kept = {sig: s for (_, sig, s), b in zip(some, at) if int(bitmap[b >> 6]) >> (b & 63) & 1}
            yield pd.DataFrame({"sig": np.fromiter(kept, np.int64, len(kept)), "hashes": [s.tobytes() for s in kept.values()]})

    sets = common.stored(docs.mapInPandas(whole, "sig long, hashes binary"))

    def all_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some = {sig: (len(h) // 8, np.frombuffer(h, np.uint64)) for sig, h in zip(batch["sig"].tolist(), batch["hashes"].tolist())}
            yield from _packed(some, buckets, heavy_h)

    def ordered(rows: pd.DataFrame) -> pd.DataFrame:
        join = lambda c, t: np.frombuffer(b"".join(rows[c]), t)
        counts = join("counts", np.int32)
        s, n = np.repeat(join("sigs", np.int64), counts), np.repeat(join("sizes", np.int32), counts).astype(np.int64)
        h, length = join("hashes", np.uint64), join("lengths", np.int32)
        order = np.lexsort((h, length, s))
        s, n, h, length = s[order], n[order], h[order], length[order]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        shared = np.diff(np.append(starts, len(s)))
        central = np.add.reduceat(np.log2(length), starts) / n[starts] if len(s) else np.zeros(0)
        rank = np.arange(len(s)) - np.repeat(starts, shared)
        alone = np.repeat(n[starts] - shared, shared)
        keep = rank <= np.repeat(shared - least_shared(n[starts]), shared)
        return pd.DataFrame({"sig": s[keep], "n": n[keep], "token": h[keep].view(np.int64), "place": (alone + rank)[keep], "central": np.repeat(central, shared)[keep]})

    tokens = _shared(sets.mapInPandas(all_of, POSTINGS), slabs, heavy, True).groupBy("slab").applyInPandas(ordered, "sig long, n long, token long, place long, central double")
    tokens = common.stored(tokens)

    found = docs.sparkSession.createDataFrame([], "src long, dst long")
    done = docs.sparkSession.createDataFrame([], "probe long, target long")
    open_ = tokens.withColumn("component", F.col("sig"))
    for step in range(rounds + 1):
        lists = open_.groupBy("token").agg(F.max_by(F.struct("sig", "n", "place", "component"), F.struct("central", "sig")).alias("lead"), F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size")).where("a != b").select("token", "lead", "size")
        lists = common.stored(lists)
        if lists.isEmpty():
            break
        # x and y link only if their shingles from the first common one on are enough
        fits = lambda x, y: (F.least(x["n"] - x["place"], y["n"] - y["place"]) * (100 + PERCENT) >= PERCENT * (x["n"] + y["n"])) & (x["component"] != y["component"])
        if step < rounds:
            met = open_.join(lists.drop("size"), "token").where(fits(F.col("lead"), open_))
            pairs = met.select(F.col("lead.sig").alias("probe"), F.col("sig").alias("target")).distinct()
        else:
            pairs = pairs_within_lists(open_.select("token", "sig", "n", "place", "component"), lists.select("token", "size"))
        pairs = pairs.join(done, ["probe", "target"], "left_anti").join(done.select(F.col("probe").alias("target"), F.col("target").alias("probe")), ["probe", "target"], "left_anti")
        pairs = common.stored(pairs)
        found = common.stored(found.unionByName(_compare(pairs, sets)))
        done = done.unionByName(pairs)
        if step < rounds:
            labels = connected_components(found)
            open_ = tokens.join(labels, tokens["sig"] == labels["node"], "left").select(*tokens.columns, F.coalesce("component", "sig").alias("component"))
    return found


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    return _joined(docs).drop("text_hash")


def _joined(docs: DataFrame) -> DataFrame:
    """join_documents, and the text_hash that tells rows with equal doc_id apart."""
    docs = common.texts_of(docs)
    known = common.stored(document_sets(docs))
    documents = known.where("not many").drop("many")
    total = documents.count()
    often = known.where("many").groupBy("sig").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= max(1000, total // 400))
    heavy = {int(h) & 0xFFFFFFFFFFFFFFFF: int(n) for h, n in often.collect()}
    named = documents.where("sig is not null and doc_id is not null")
    found = links(docs.where("doc_id is not null"), named, heavy)
    owners = common.stored(named.groupBy("sig").agg(F.min("doc_id").alias("owner")))
    labels = connected_components(found)
    grouped = common.stored(labels.join(owners, labels["node"] == owners["sig"]).select("sig", "component", "owner"))
    least = common.stored(grouped.groupBy("component").agg(F.min("owner").alias("least")))
    least = grouped.join(least, "component").select("sig", "least")
    classes = common.stored(owners.join(least, "sig", "left").select("sig", F.coalesce("least", "owner").alias("class")))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    return documents.join(classes, "sig", "left").select("doc_id", "n_shingles", own.alias("component_id"), "text_hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component the one with the least doc_id, and of rows with equal doc_id each. A row goes by its doc_id and text, so that another text under its doc_id stays. Columns as they were."""
    gone = _joined(docs).where("doc_id != component_id").select(F.col("doc_id").alias("dropped"), "text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own_hash"))
    return rows.join(gone, (F.col("own") == F.col("dropped")) & (F.col("own_hash") == F.col("text_hash")), "left_anti").select("row.*")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(common.table(spark, sf_dir, "documents"))


#: The same rows by joining shingles with shingles.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT h FROM s GROUP BY h HAVING count(*) > 1
), t AS (
  SELECT s.* FROM s JOIN shared USING (h)
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM t a JOIN t b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT DISTINCT a AS node, a AS c FROM edge
  UNION SELECT e.b, r.c FROM reach r JOIN edge e ON e.a = r.node WHERE r.c < e.b
), comp AS (
  SELECT node, min(c) AS c FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp c ON c.node = d.doc_id
"""
