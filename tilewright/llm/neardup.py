"""Near-duplicates by an LSH forest of MinHash signatures, confirmed on full shingle sets.

Every document becomes the set of its distinct five-word shingles (64-bit hashes) and a signature of TREES x STEP short
hashes. Documents of one set form a class. Each tree sorts the signatures from another place on; classes that share a
prefix there form a region. Within a region, candidates are neighbours in the sorted order, whose common prefix is
longest, and the member nearest to the region's consensus with each other member. Regions above REGION members go
deeper, to the DEPTHS in turn, where their members already have a candidate with a common centre. Confirmed links give components; a second
look at each region then counts the shared shingles of members that are still apart with all others, so that no link is lost
that the forest can see. Regions above REGION are looked at whole too, whatever their depth: their members are posted under their
rarest shingles, so many that every pair at the threshold shares one, and those of different components meet there.

At a similarity of 0.85 a tree of depth 4 misses a pair with probability 0.48, all 24 with 2e-8; at 0.8 with 0.59 and 3e-6.
Candidates need as many equal values of the 96 as a pair at the threshold has but with a probability of some 1e-6 (64 for 0.85,
57 for 0.8).

A null, empty or blank text has an empty set and is linked with nothing. With fewer than five words the whole sequence
is the one shingle. Repeated rows share class and component; ties cannot matter, as a component's id is its smallest
doc_id. A null doc_id is never smallest unless alone. Empty tables give empty results. Only the id and text columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import connected_components, durable, slices

SHINGLE, TREES, STEP = 5, 24, 4
#: Depths of the trees in steps of STEP values; only regions above REGION go beyond the first.
DEPTHS = (1, 4)
VALUES = TREES * STEP
REGION, FEW = 512, 8
SAMPLE = 512
#: Shingles are counted by the leading bits of their hashes; sets of sizes within a factor WIDER form a size class.
BUCKETS, WIDER = 1 << 18, 1.06
_BUCKET = np.uint64(64 - 18)
BROADCAST_KEYS = 200_000
#: Bytes of text that are hashed at once; longer texts are hashed in parts that end with a word.
BLOCK = 1 << 22

_RNG = np.random.default_rng(20240517)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, VALUES, dtype=np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def least_equal(percent: int) -> int:
    """Equal values that a pair at the threshold has, less 4.9 standard deviations."""
    p = min(percent, 100) / 100
    return max(1, int(VALUES * p - 4.9 * (VALUES * p * (1 - p)) ** 0.5))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of data: sums of byte values times powers of an odd base, per word."""
    raw = np.frombuffer(data, np.uint8)
    dark = np.concatenate(([False], ~_BLANK[raw], [False]))
    edge = np.flatnonzero(dark[1:] != dark[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    longest = int(lengths.max())
    power = np.full(longest, _BASE)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    term = _BYTE[raw[dark[1:-1]]] * power[at]
    first = np.cumsum(lengths) - lengths
    return _mix(np.add.reduceat(term, first) + lengths.astype(np.uint64)), starts


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        data = b"\n".join(group)
        ends = np.cumsum([len(x) + 1 for x in group])
        hashes, starts = _word_hashes(data)
        bounds = [0, *np.searchsorted(starts, ends).tolist()]
        for a, b in zip(bounds, bounds[1:], strict=False):
            out.append(_shingles(hashes[a:b]))
        group.clear()
        size = 0

    for text in texts:
        data = (text or "").encode().lower()
        if len(data) > BLOCK:
            if group:
                flush()
            parts, at = [], 0
            while at < len(data):
                end = min(at + BLOCK, len(data))
                while end < len(data) and not _BLANK[data[end]]:
                    end += 1
                parts.append(_word_hashes(data[at:end])[0])
                at = end
            out.append(_shingles(np.concatenate(parts)))
            continue
        group.append(data)
        size += len(data)
        if size >= BLOCK:
            flush()
    if group:
        flush()
    return out


def _shingles(h: np.ndarray) -> np.ndarray:
    n = len(h)
    if n == 0:
        return h
    k = min(n, SHINGLE)
    total = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        total += _mix(h[i : n - k + 1 + i]) * _PLACE[i]
    return np.unique(_mix(total))


def signature(shingles: np.ndarray) -> bytes:
    """VALUES short hashes of the smallest shingle under as many orders; empty sets have none."""
    if not len(shingles):
        return b""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i : i + 2048, None] * _MUL + _ADD).min(axis=0), out=low)
    return (_mix(low.astype(np.uint64) + np.arange(VALUES, dtype=np.uint64) * _BASE) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _name(shingles: np.ndarray) -> bytes:
    """128 bits that name a set: two sums of its mixed members."""
    return int(_mix(shingles).sum(dtype=np.uint64)).to_bytes(8, "big") + int(_mix(shingles ^ _BASE).sum(dtype=np.uint64)).to_bytes(8, "big")


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, cls, sig) for each row, as a durable table; cls names the set, null if empty."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    names = ["doc_id", "text_key", "n_shingles", "cls", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2, 1024):
                sets = shingle_sets(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_name(s) if len(s) else None for s in sets], pa.binary()), pa.array([signature(s) for s in sets], pa.binary()),
                ], names=names)

    return durable(rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, cls binary, sig binary"), "signed")


def _prefix(tree: int, depth: int):
    """Bytes of `depth` steps of the order that starts at the tree's place and wraps around."""
    return F.substring(F.concat("sig", "sig"), 2 * STEP * tree + 1, 2 * STEP * depth)


def _counted(rows: DataFrame) -> DataFrame:
    """rows of regions with two members or more, with their number: counts are made map-side, so a large region is no single task."""
    many = durable(rows.groupBy("region").agg(F.count("*").alias("members")).where("members > 1"), "counted")
    return rows.join(sized(many), "region")


def regions(classes: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(region, cls, deep, sig) of each region of 2 to REGION members, and of deeper parts of larger ones; the centre pairs of larger
    ones; and (region, cls) of the larger ones themselves (both None if there are none).

    Classes meet by prefix with their names alone; signatures join those that share a region.
    """
    light = classes.select("cls", F.explode(F.array(*[F.xxhash64(F.lit(t), _prefix(t, 1)) for t in range(TREES)])).alias("region"))
    met = durable(_counted(light), "regions")
    done = met.where(F.col("members") <= REGION).select("region", "cls", F.lit(False).alias("deep"))
    heavy = met.where(F.col("members") > REGION)
    whole = None if heavy.isEmpty() else heavy.select("region", "cls")
    centres, rounds = None, list(zip(DEPTHS, DEPTHS[1:], strict=False)) if whole is not None else []
    for shallow, deep in rounds:
        full = durable(heavy.select("region", "cls", "members").join(classes.select("cls", "sig"), "cls"), "heavy")
        near = _centre_pairs(full)
        centres = near if centres is None else centres.union(near)
        # the tree of a region is the one whose prefix gives its name
        named = lambda t, depth: F.xxhash64(F.lit(t), _prefix(t, depth)) if depth == 1 else F.xxhash64(F.lit(t), F.lit(depth), _prefix(t, depth))
        trees = F.filter(F.array(*[F.struct(named(t, shallow).alias("was"), named(t, deep).alias("now")) for t in range(TREES)]), lambda x: x["was"] == F.col("region"))
        met = durable(_counted(full.select("cls", trees[0]["now"].alias("region"))), "regions")
        done = done.union(met.where(F.col("members") <= REGION).select("region", "cls", F.lit(True)))
        heavy = met.where(F.col("members") > REGION)
        if heavy.isEmpty():
            break
    return durable(done.join(classes.select("cls", "sig"), "cls").select("region", "cls", "deep", "sig"), "members"), centres, whole


def _centre_pairs(full: DataFrame) -> DataFrame:
    """(a, b): each member of a large region with the member nearest to the region's consensus.

    The consensus is the commonest value at each place among some SAMPLE members (chosen by hash; they only pick the centre).
    """
    pick = full.where(F.pmod(F.xxhash64("cls"), F.ceil(F.col("members") / SAMPLE)) == 0)

    def consensus(pdf):
        import pandas as pd

        sigs = np.stack([np.frombuffer(s, "<u2") for s in pdf["sig"]])
        return pd.DataFrame({"region": [pdf["region"].iloc[0]], "mode": [_modes(sigs).astype("<u2").tobytes()]})

    modes = durable(pick.select("region", "sig").groupBy("region").applyInPandas(consensus, "region long, mode binary"), "modes")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, m = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(-1, VALUES) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((a == m).sum(axis=1), pa.int32())], names=["region", "cls", "same"])

    rated = full.join(sized(modes), "region").select("region", "cls", "sig", "mode").mapInArrow(agree, "region long, cls binary, same int")
    rated = durable(rated, "rated")
    centre = rated.groupBy("region").agg(F.max_by("cls", F.struct("same", "cls")).alias("b"))
    return rated.join(sized(centre), "region").select(F.col("cls").alias("a"), "b").where("a <> b")


def _modes(sigs: np.ndarray) -> np.ndarray:
    s = np.sort(sigs, axis=0)
    n = len(s)
    best, run = s[0].copy(), np.ones(s.shape[1], int)
    most = run.copy()
    for i in range(1, n):
        run = np.where(s[i] == s[i - 1], run + 1, 1)
        best = np.where(run > most, s[i], best)
        most = np.maximum(most, run)
    return best


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(columns) of each region of a partition sorted by region, whole regions at a time."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        r = t.column(0).to_numpy()
        cut = np.flatnonzero(r[1:] != r[:-1]) + 1
        last = int(cut[-1]) if len(cut) else 0
        rest = t.slice(last)
        if last:
            yield t.slice(0, last), np.concatenate(([0], cut))
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _column(t: pa.Table, i: int) -> list:
    """Values of a column; arrays of numbers as views, not lists."""
    c = t.column(i).combine_chunks()
    if not pa.types.is_list(c.type):
        return c.to_pylist()
    ends, flat = c.offsets.to_numpy(), c.values.to_numpy()
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _pairs_of(members: DataFrame, chooser) -> DataFrame:
    """Distinct (a, b), a < b, that chooser(sigs, more columns) yields as index pairs for each region."""
    columns = members.columns
    rows = members.repartition("region").sortWithinPartitions("region")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in _groups(batches):
            cls = t.column(1).to_pylist()
            sigs = np.frombuffer(b"".join(t.column(2).to_pylist()), "<u2").reshape(-1, VALUES)
            more = [_column(t, i) for i in range(3, len(columns))]
            a, b = [], []
            for lo, hi in zip(cut, cut[1:], strict=False):
                for i, j in chooser(sigs[lo:hi], *[m[lo:hi] for m in more]):
                    x, y = cls[lo + i], cls[lo + j]
                    a.append(min(x, y))
                    b.append(max(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary").where("a <> b").distinct()


def _near(sigs: np.ndarray, least: int) -> list[tuple[int, int]]:
    """First look: all pairs of few members; else neighbours in sorted order and the centre with each."""
    n = len(sigs)
    if n <= FEW:
        i, j = np.triu_indices(n, 1)
    else:
        centre = int((sigs == _modes(sigs)).sum(axis=1).argmax())
        order = np.lexsort(sigs.T[::-1])
        i = np.concatenate((order[:-1], np.full(n - 1, centre)))
        j = np.concatenate((order[1:], np.delete(np.arange(n), centre)))
    ok = (sigs[i] == sigs[j]).sum(axis=1) >= least
    return list(zip(i[ok].tolist(), j[ok].tolist(), strict=True))


def _apart(sigs: np.ndarray, component: list[bytes], sets: list[np.ndarray], percent: int, asks: list[bool] | None = None) -> Iterator[tuple[int, int]]:
    """Second look: links between different components, from each member outside the largest one (or that asks) to all others.

    Shared shingles are counted by postings within the region; one link for a member and component is enough.
    """
    _, part, count = np.unique(np.array([c.hex() for c in component]), return_inverse=True, return_counts=True)
    least = least_equal(percent)
    outside = np.flatnonzero(part != count.argmax() if asks is None else np.array(asks))
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(term, kind="stable")
    posted, ptr = owner[order], np.concatenate(([0], np.cumsum(np.bincount(term))))
    first = np.concatenate(([0], np.cumsum(sizes)))
    for x in outside:
        if not ((part != part[x]) & ((sigs == sigs[x]).sum(axis=1) >= least)).any():
            continue
        mine = term[first[x] : first[x + 1]]
        lengths = ptr[mine + 1] - ptr[mine]
        at = np.repeat(ptr[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        same = np.bincount(posted[at], minlength=len(sets))
        hit = np.flatnonzero((part != part[x]) & (100 * same >= percent * (sizes + sizes[x] - same)))
        for y in hit[np.unique(part[hit], return_index=True)[1]]:
            yield int(x), int(y)


def sized(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else small


def full_sets(need: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(cls, members) of the classes in need(cls, doc_id, text_key), made again from a text of each, as a durable table."""
    need = durable(need, "needed")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    same = rows["doc_id"].eqNullSafe(need["doc_id"]) & (rows["text_key"] == need["text_key"])
    texts = rows.join(sized(need), same).select("cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, 512):
                sets = shingle_sets(b.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["cls", "members"])

    return durable(texts.mapInArrow(run, "cls binary, members array<long>").dropDuplicates(["cls"]), "sets")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Those pairs whose full sets have 100 * intersection >= percent * union, as a durable table."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "doc_id", "text_key"), "cls")
    sets = full_sets(need, docs, key, text)
    left = sets.select(F.col("cls").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("members").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("same"))
    return durable(both.where(100 * F.col("same") >= percent * (F.col("nx") + F.col("ny") - F.col("same"))).select("a", "b"), "links")


def second_look(members: DataFrame, parts: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Links between components within regions of more than FEW members (smaller ones had all their pairs tested)."""
    members = members.where("not deep").drop("deep")  # parts of larger regions: whole_look has all their pairs
    looked = members.join(parts, members["cls"] == parts["node"], "left").select("region", "cls", "sig", F.coalesce("component", "cls").alias("component"))
    mixed = looked.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where(f"lo <> hi and n > {FEW}").select("region")
    looked = durable(looked.join(mixed, "region", "left_semi"), "mixed")
    if looked.isEmpty():
        return looked.select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    need = looked.select("cls").distinct().join(classes.select("cls", "doc_id", "text_key"), "cls")
    sets = full_sets(need, docs, key, text)
    return durable(_pairs_of(looked.join(sets, "cls").select("region", "cls", "sig", "component", "members"), lambda s, c, m: _apart(s, c, m, percent)), "links")


def commonness(sets: DataFrame) -> np.ndarray:
    """How many of sets(cls, members) hold a shingle of each of BUCKETS buckets; counted within tasks, then by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy().view(np.uint64) >> _BUCKET, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in sets.select("members").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def _size_class(n: int) -> int:
    return int(np.floor(np.log(n) / np.log(WIDER) + 1e-9))


def _prefixes(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(smaller size class, larger one, so many of the first shingles) for each class of sizes that a set of n can be linked with.

    A pair at the threshold shares at least percent (n + m) / (100 + percent) shingles, so in any common order the first n less that, plus one,
    of each side meet.
    """
    mine, out = _size_class(n), []
    for c in range(_size_class(max(1, -(-percent * n // 100))), _size_class(100 * n // percent) + 1):
        m = max(int(np.ceil(WIDER**c - 1e-9)), -(-percent * n // 100), 1)
        shared = max(1, -(-percent * (n + m) // (100 + percent)))
        if n >= shared:
            out.append((min(mine, c), max(mine, c), n - shared + 1))
    return out


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """(region, side, cls, component) of sets(cls, members, component): each class under its rarest shingles, so many that every pair at the threshold shares one; region names shingle and two
    size classes, and side says in which of them the class is (2: both are the same).

    The order is by the count of a shingle's bucket and then by its hash: the same for all sets, whatever their sizes.
    """
    held = sets.sparkSession.sparkContext.broadcast(commonness(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                names, keys, sides, parts = [], [], [], []
                for cls, x, part in zip(b.column(0).to_pylist(), _column(pa.Table.from_batches([b]), 1), b.column(2).to_pylist(), strict=True):
                    x = x.view(np.uint64)
                    if len(x) not in known:
                        known[len(x)] = _prefixes(len(x), percent)
                    x = x[np.lexsort((x, held.value[x >> _BUCKET]))]
                    for lo, hi, n in known[len(x)]:
                        keys.append(_mix(x[:n] ^ _mix(np.array([(lo << 20) + hi + 1], np.uint64))).view(np.int64))
                        names += [cls] * n
                        parts += [part] * n
                        sides += [2 if lo == hi else int(hi == _size_class(len(x)))] * n
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(sides, pa.int32()), pa.array(names, pa.binary()), pa.array(parts, pa.binary())], names=["region", "side", "cls", "component"])

    return sets.select("cls", "members", "component").mapInArrow(run, "region long, side int, cls binary, component binary")


def whole_look(whole: DataFrame, parts: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Links between components within regions above REGION, none of whose pairs is left out.

    The regions' members are posted under their rarest shingles; a posting matters if it has members of two components. There the members
    outside its largest component ask all, or, for two classes of sizes, those of the smaller side ask the other. Where many share one posting,
    askers, in blocks of REGION / 2, meet each block of members in a cell of its own.
    """
    half = max(1, REGION // 2)
    looked = whole.join(parts, whole["cls"] == parts["node"], "left").select("region", "cls", F.coalesce("component", "cls").alias("component"))
    ends = looked.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("region")
    mixed = durable(looked.join(sized(ends), "region", "left_semi").select("cls", "component").distinct(), "mixed")
    nothing = mixed.limit(0).select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    if mixed.isEmpty():
        return nothing
    sets = full_sets(mixed.select("cls").join(classes.select("cls", "doc_id", "text_key"), "cls"), docs, key, text)
    posted = durable(postings(sets.join(mixed, "cls"), percent), "posted")
    of = lambda side: F.count(F.when(F.col("side") == side, 1))
    ends = posted.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), of(0).alias("n0"), of(1).alias("n1"), of(2).alias("n2"))
    ends = ends.where("lo <> hi and (n2 > 0 or (n0 > 0 and n1 > 0))").select("region", "n0", "n1")
    looked = durable(posted.join(sized(ends), "region"), "looked")
    if looked.isEmpty():
        return nothing
    # of one size class, all outside the posting's largest component ask; of two, the side of fewer members asks the other
    size = looked.where("side = 2").groupBy("region", "component").agg(F.count("*").alias("n"))
    largest = durable(size.groupBy("region").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")), "largest")
    parted = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / half)).cast("int")
    same = looked.where("side = 2").join(sized(largest), "region").withColumn("askers", F.col("n") - F.col("most"))
    same = same.select("region", "cls", "component", (F.col("component") != F.col("main")).alias("asks"), F.lit(True).alias("hears"), "n", parted("n").alias("blocks"), parted("askers").alias("groups"))
    asks = F.col("side") == F.when(F.col("n0") <= F.col("n1"), 0).otherwise(1)
    cross = looked.where("side < 2").withColumns({"few": F.least("n0", "n1"), "many": F.greatest("n0", "n1")})
    cross = cross.select("region", "cls", "component", asks.alias("asks"), (~asks).alias("hears"), (F.col("n0") + F.col("n1")).alias("n"), parted("many").alias("blocks"), parted("few").alias("groups"))
    met = same.unionByName(cross)
    few = met.where(F.col("n") <= REGION).select("region", "cls", "component", "asks")
    many = met.where(F.col("n") > REGION)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    ask = many.where("asks").select("region", "cls", "component", F.lit(True).alias("asks"), mine("groups").alias("g"), all_of("blocks").alias("b"))
    hear = many.where("hears").select("region", "cls", "component", F.lit(False).alias("asks"), all_of("groups").alias("g"), mine("blocks").alias("b"))
    cells = few.unionByName(ask.union(hear).select(F.xxhash64("region", "g", "b").alias("region"), "cls", "component", "asks"))
    data = sets.join(classes.select("cls", "sig"), "cls")
    rows = cells.join(data, "cls").select("region", "cls", "sig", "component", "members", "asks")
    return durable(_pairs_of(rows, lambda s, c, m, q: _apart(s, c, m, percent, q)), "links")


def placed(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, chosen) for each row of docs; chosen: the row is its group's one, or like it in id and text.

    A group's one is the row of the smallest id (a null id comes last), among texts of one id the one of the smallest hash.
    """
    rows = signed(docs, key, text)
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "sig")).alias("m"), F.count("*").alias("copies"))
    classes = durable(classes.select("cls", "m.doc_id", "m.text_key", "m.sig", "copies"), "classes")
    members, centres, whole = regions(classes)
    first = _pairs_of(members.select("region", "cls", "sig"), lambda s: _near(s, least_equal(percent)))
    if centres is not None:
        first = first.union(centres.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    links = confirmed(durable(first, "pairs"), classes, docs, key, text, percent)
    parts = durable(connected_components(links), "parts")
    more = second_look(members, parts, classes, docs, key, text, percent)
    if whole is not None:
        more = more.union(whole_look(whole, parts, classes, docs, key, text, percent))
    if not more.isEmpty():
        parts = connected_components(links.union(more))
    named = classes.join(parts, classes["cls"] == parts["node"], "left").select("cls", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key").alias("own"), "copies", "component")
    least = named.where("component is not null").groupBy("component").agg(F.min("own").alias("least"))
    named = named.join(least, "component", "left").where("copies > 1 or component is not null").select("cls", F.coalesce("least", "own").alias("one"))
    out = rows.select("doc_id", "text_key", "n_shingles", "cls").join(named, "cls", "left")
    same = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("text_key") == F.col("one.text_key"))
    return out.select("doc_id", "text_key", "n_shingles", F.coalesce("one.doc_id", "doc_id").alias("component_id"), (F.col("one").isNull() | same).alias("chosen"))


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    out = placed(docs, key, text, percent).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """docs with one row of each group. Rows of one id with different texts are told apart, of repeated rows one stays, and a null id
    is an id like others; rows without words are in no group and stay. Inner columns are named `_n_*`."""
    found = durable(placed(docs, key, text, percent).select("doc_id", "text_key", "n_shingles", "chosen"), "placed")
    gone = durable(found.where("not chosen").select("doc_id", "text_key").distinct(), "gone")
    twice = durable(found.where("chosen and n_shingles > 0").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "twice")
    rows = docs.withColumns({"_n_id": F.col(key).cast("long"), "_n_text": F.xxhash64(text)})

    def meets(keys: DataFrame, how: str) -> DataFrame:
        k = sized(keys.select(F.col("doc_id").alias("_n_key_id"), F.col("text_key").alias("_n_key_text")))
        return rows.join(k, F.col("_n_id").eqNullSafe(F.col("_n_key_id")) & (F.col("_n_text") == F.col("_n_key_text")), how)

    if not twice.isEmpty():
        again = meets(twice, "left_semi").dropDuplicates([key, text])
        rows = meets(twice, "left_anti").unionByName(again)
    return meets(gone, "left_anti").drop("_n_id", "_n_text")
