"""Near-duplicate documents: a chosen-path set similarity join with exact confirmation.

A document's set holds 64-bit hashes of its distinct word shingles. Documents with the same set are one from the start
(``classes``). The join itself has three steps.

1. *Paths.* In each of ``TREES`` independent trees a document follows, level by level, the ``BRANCHES`` smallest tokens of its
   set under that level's hash, so it is in a few nodes of a tree and similar sets meet in one with high probability. Nodes of at
   most ``NODE`` documents are leaves; larger ones branch again, up to ``LEVELS`` times. Sets with similarity 0.8 miss each
   other in one tree with probability below 0.15, in all trees below 1e-6.
2. *Leaves.* Documents of a leaf are compared exhaustively by sketches (one permutation, 128 bins) with a threshold
   five standard deviations below the wanted one. A leaf that is still too large after the last level isn't compared: all of its
   documents become candidates of each other. Either way only a spanning forest leaves the node, never all pairs.
3. *Confirmation.* Connected candidates form a bundle, and each bundle is searched exhaustively on the full sets of
   whole texts: breadth first, so members that are found are never compared again. A bundle of more than
   ``BLOCK`` documents is dealt to blocks by hash; then the blocks' leaders meet; if that leaves a bundle in several
   components, every member outside the largest one is compared with every block, by odd sketches, which lose no link (``odd_near``);
   texts go only to members that these still join, and are confirmed in the same way. Nothing is cut off.

Links go between class representatives; membership and components follow from them. Cases: a null text or one without words has an empty
set and is linked with nothing; repeated rows share a set; a row without doc_id takes no part: it has no
component and is kept. Columns beyond doc_id and text are not read, except by ``deduplicate``, which carries them along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.llm._batches import Words, chunks, mix, windows
from crossloom.operators.graph import connected_components
from crossloom.runtime import materialise, partitions, prepare

TREES = 8
LEVELS = 3
BRANCHES = 2
NODE = 256
BINS = 128
SIGMAS = 5.0
BLOCK = 512
#: A block also holds no more shingles than this on average, so a task's sets stay under about 100 MB.
BLOCK_SHINGLES = 8_000_000
#: Odd sketches meet in larger blocks: they have an eighth or so of the bytes of a set.
ODD_BLOCK = 4096
#: Written tables have a file for so many documents, or two for each core.
ROWS_PER_TASK = 50_000
#: So many (id, bundle) rows at most are broadcast to the texts, about 32 MB; beyond that, both sides are shuffled.
BROADCAST_MEMBERS = 1_000_000

_SEED = mix(np.arange(1, TREES * LEVELS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(column: pa.Array, size: int):
    """For each chunk of texts: (rows from, to, offsets of sets, tokens sorted within each set)."""
    for i, j, data, offsets in chunks(column):
        doc, h = windows(Words(data, offsets), size)
        if len(h):
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            doc, h = doc[new], h[new]
        yield i, j, np.searchsorted(doc, np.arange(j - i + 1)), h


def _min_two(h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two smallest values of each slice (of one value: that twice)."""
    first = np.minimum.reduceat(h, starts)
    rest = h.copy()
    rest[h == np.repeat(first, counts)] = np.uint64(2**64 - 1)
    second = np.minimum.reduceat(rest, starts)
    return first, np.where(second == np.uint64(2**64 - 1), first, second)


def _profile(offsets: np.ndarray, tokens: np.ndarray) -> dict[str, list]:
    """Of non-empty sets: digest of the set, tokens chosen by each tree and level, sketch."""
    full = np.flatnonzero(np.diff(offsets))
    starts, counts = offsets[:-1][full], np.diff(offsets)[full]
    total = np.add.reduceat(mix(tokens ^ np.uint64(0xABCDEF)), starts) + counts.astype(np.uint64)
    other = np.bitwise_xor.reduceat(mix(tokens + np.uint64(0x1234567)), starts)
    chosen = np.empty((len(full), TREES * LEVELS * BRANCHES), np.uint64)
    for k, seed in enumerate(_SEED):
        chosen[:, 2 * k], chosen[:, 2 * k + 1] = _min_two(mix(tokens ^ seed), starts, counts)
    sketch = np.zeros(len(full) * BINS, np.uint8)
    bins = np.repeat(np.arange(len(full)) * BINS, counts) + (tokens & np.uint64(BINS - 1)).astype(np.int64)
    value = 1 + ((tokens >> np.uint64(20)) % np.uint64(255)).astype(np.uint8)
    sketch[bins[::-1]] = value[::-1]  # the smallest token of a bin is written last
    return {"full": full, "n": counts, "d1": total.view(np.int64), "d2": other.view(np.int64), "chosen": chosen.view(np.int64), "sketch": sketch.reshape(-1, BINS)}


_SETS = "doc_id long, n_shingles long, d1 long, d2 long, chosen array<long>, sketch binary"


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, and for non-empty sets d1, d2 (a digest of the set), chosen, sketch."""
    prepare(docs.sparkSession)

    def run(batches):
        kinds = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("chosen", pa.list_(pa.int64())), ("sketch", pa.binary())])
        for b in batches:
            for i, j, offsets, tokens in shingle_sets(b.column(1), size):
                n = j - i
                count = np.diff(offsets)
                none = np.ones(n, bool)
                cols = [b.column(0).slice(i, n), pa.array(count.astype(np.int64))]
                if len(tokens):
                    p = _profile(offsets, tokens)
                    none[p["full"]] = False
                    place = np.cumsum(~none) - 1
                    put = lambda x: pa.array(x[np.maximum(place, 0)], mask=none)  # noqa: E731, B023
                    k = p["chosen"].shape[1]
                    ends = np.concatenate([[0], np.cumsum(np.where(none, 0, k))]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(none, False)), pa.array(p["chosen"].ravel()))
                    sketches = iter([r.tobytes() for r in p["sketch"]])
                    cols += [put(p["d1"]), put(p["d2"]), lists, pa.array([None if x else next(sketches) for x in none], pa.binary())]
                else:
                    cols += [pa.nulls(n, t) for t in kinds.types[2:]]
                yield pa.RecordBatch.from_arrays(cols, schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SETS)


def _sent(df: DataFrame) -> DataFrame:
    """To be broadcast, if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_MEMBERS else df


def leaves(reps: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaf, rep) for every leaf with two documents or more; (leaf, rep) for those too large after the last level, by groups' first documents;
    and (a, b): these groups' members.

    From the second level on, documents of a node with the same tokens at all further levels of its tree go the same ways. They travel as one
    group, which counts with all its members, and are put in their members' place where a way ends."""
    tokens = reps.select("rep", "chosen")
    first = [(k // BRANCHES, (k // BRANCHES) * LEVELS * BRANCHES + k % BRANCHES) for k in range(TREES * BRANCHES)]
    nodes = F.array(*(F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.get("chosen", F.lit(at))).alias("node")) for t, at in first))
    level = tokens.select("rep", F.explode(F.array_distinct(nodes)).alias("x")).select("rep", "x.tree", "x.node")
    sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    held = materialise(level.join(sizes, "node").coalesce(tasks), "paths")
    met = held.where(F.col("size") <= NODE).select(F.col("node").alias("leaf"), "rep")
    big = held.where(F.col("size") > NODE)
    none = reps.sparkSession.createDataFrame([], "a long, b long")
    if LEVELS == 1 or not big.limit(1).count():
        return met, big.select(F.col("node").alias("leaf"), "rep"), none
    further = F.slice("chosen", (F.col("tree") * LEVELS + 1) * BRANCHES + 1, (LEVELS - 1) * BRANCHES)
    members = big.select("node", "tree", "rep").join(tokens, "rep").select("rep", "node", further.alias("further"))
    members = materialise(members.withColumn("grp", F.xxhash64("node", "further")).coalesce(tasks), "members")
    way = members.groupBy("grp").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min("node").alias("node"), F.min("further").alias("further"))
    for depth in range(LEVELS - 1):
        children = F.array(*(F.xxhash64("node", F.get("further", F.lit(depth * BRANCHES + k))) for k in range(BRANCHES)))
        way = way.select("grp", "rep", "weight", "further", F.explode(F.array_distinct(children)).alias("node")).dropDuplicates(["grp", "node"])
        sizes = way.groupBy("node").agg(F.sum("weight").alias("size")).where("size > 1")
        held = materialise(way.join(sizes, "node").coalesce(tasks), "paths")
        ends = _sent(held.where(F.col("size") <= NODE).select("grp", F.col("node").alias("leaf")))
        met = met.unionByName(members.select("grp", "rep").join(ends, "grp").select("leaf", "rep"))
        way = held.where(F.col("size") > NODE).select("grp", "rep", "weight", "further", "node")
        if not way.limit(1).count():
            break
    inner = members.select("grp", F.col("rep").alias("b")).join(_sent(way.select("grp", F.col("rep").alias("a")).distinct()), "grp").where("a <> b").select("a", "b")
    return met, way.select(F.col("node").alias("leaf"), "rep"), inner


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n by the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _pairs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j within groups that follow each other."""
    first = np.repeat(np.cumsum(counts) - counts, counts)
    own = np.arange(len(first))
    before = own - first
    j = np.repeat(own, before)
    i = np.arange(len(j)) - np.repeat(np.cumsum(before) - before, before) + np.repeat(first, before)
    return i, j


def _grouped(batches, key_columns: int):
    """Tables of whole groups from batches that are sorted by their first columns; a table ends where a batch's last group
    begins, so memory holds a batch and a group."""
    held: list = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(*(b.column(k).to_pylist() for k in range(key_columns)), strict=True))
        cut = b.num_rows
        while cut and keys[cut - 1] == keys[-1]:
            cut -= 1
        if cut == 0 and keys[-1] == last:
            held.append(b)
            continue
        if cut == 0:
            if held:
                yield pa.Table.from_batches(held)
            held = [b]
        else:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def _counts_of(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return np.diff(np.append(at, len(new)))


def candidates(reps: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """(a, b): a spanning forest of the candidate links of every leaf."""
    spark = reps.sparkSession
    met, deep, inner = leaves(reps, tasks)
    # A leaf that is still too large may hold a third of all rows: its rows stay where they are, its first document is sent to them.
    firsts = _sent(materialise(deep.groupBy("leaf").agg(F.min("rep").alias("a")).coalesce(tasks), "firsts"))
    stars = deep.join(firsts, "leaf").where("a <> rep").select("a", F.col("rep").alias("b")).unionByName(inner)

    def compare(batches):
        for t in _grouped(batches, 1):
            leaf, rep, n = (t.column(k).to_numpy() for k in range(3))
            sketch = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint8).reshape(-1, BINS)
            counts = _counts_of(leaf)
            whole = np.cumsum(counts * (counts - 1) // 2)
            at = np.append(0, np.cumsum(counts))
            done = 0
            while done < len(counts):  # so many groups at once that they make about 30,000 pairs
                upto = max(done + 1, int(np.searchsorted(whole, (whole[done - 1] if done else 0) + 30_000, "right")))
                lo, hi = at[done], at[upto]
                i, j = _pairs(counts[done:upto])
                i, j = i + lo, j + lo
                near = np.minimum(n[i], n[j]) >= (threshold - 1e-9) * np.maximum(n[i], n[j])
                i, j = i[near], j[near]
                x, y = sketch[i], sketch[j]
                used = ((x > 0) | (y > 0)).sum(1)
                same = ((x == y) & (x > 0)).sum(1)
                ok = same >= used * threshold - SIGMAS * np.sqrt(used * threshold * (1 - threshold)) - 1
                label = _forest(i[ok] - lo, j[ok] - lo, hi - lo) + lo
                linked = np.flatnonzero(label != np.arange(lo, hi)) + lo
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(rep[label[linked - lo]]), pa.array(rep[linked])], names=["a", "b"])
                done = upto

    rows = met.join(reps.select("rep", "n", "sketch"), "rep").select("leaf", "rep", "n", "sketch").coalesce(tasks)
    found = rows.repartition(partitions(spark), "leaf").sortWithinPartitions("leaf", "rep").mapInArrow(compare, "a long, b long").coalesce(tasks)
    return found.unionByName(stars).distinct()


def exact_labels(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Smallest index of each set's component, where sets are linked if 100 * intersection >= percent * union."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    label = np.full(n, -1)
    open_ = np.ones(n, bool)
    for seed in range(n):
        if not open_[seed]:
            continue
        open_[seed], label[seed] = False, seed
        front = [seed]
        while front:
            x = front.pop()
            near = np.flatnonzero(open_ & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])))
            if not len(near):
                continue
            tokens = np.concatenate([sets[k] for k in near])
            at = np.minimum(np.searchsorted(sets[x], tokens), size[x] - 1)
            both = np.add.reduceat((sets[x][at] == tokens).astype(np.int64), np.cumsum(size[near]) - size[near])
            hit = near[100 * both >= percent * (size[near] + size[x] - both)]
            open_[hit], label[hit] = False, seed
            front.extend(hit.tolist())
    return label


def _confirm(rows: DataFrame, size: int, percent: int, tasks: int) -> DataFrame:
    """(a, b) links of each task, given (g, h, rep, text): exhaustive on full sets, a spanning forest goes out."""

    def run(batches):
        for t in _grouped(batches, 2):
            at = 0
            for n in _counts_of(t.column(0).to_numpy(), t.column(1).to_numpy()):
                rep = t.column(2).slice(at, n).to_numpy()
                if n > 1:
                    sets: list[np.ndarray] = []
                    for c in t.column(3).slice(at, n).chunks:
                        for _, _, offsets, tokens in shingle_sets(c, size):
                            sets += [tokens[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
                    label = exact_labels(sets, percent)
                    linked = np.flatnonzero(label != np.arange(n))
                    if len(linked):
                        yield pa.RecordBatch.from_arrays([pa.array(rep[label[linked]]), pa.array(rep[linked])], names=["a", "b"])
                at += n

    n = partitions(rows.sparkSession)
    return rows.select("g", "h", "rep", "text").repartition(n, "g", "h").sortWithinPartitions("g", "h", "rep").mapInArrow(run, "a long, b long").coalesce(tasks)


def links(docs: DataFrame, reps: DataFrame, size: int, percent: int, tasks: int) -> DataFrame:
    """(a, b): confirmed links between representatives, a spanning forest of every component."""
    bundles = connected_components(candidates(reps, percent / 100, tasks), first_tasks=tasks)
    members = bundles.withColumnRenamed("node", "rep").withColumnRenamed("component", "g")
    few = bundles.count() <= BROADCAST_MEMBERS
    shingles = reps.select("rep", "n").join(F.broadcast(members) if few else members, "rep").groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    # The size counts as what the shingles would make of it, so long texts come in smaller blocks.
    whole = F.greatest("size", F.ceil(F.col("shingles") * (BLOCK / BLOCK_SHINGLES)))
    sizes = shingles.select("g", whole.alias("size"), (whole / F.col("size")).alias("weight")).coalesce(tasks)
    members = members.join(sizes, "g").coalesce(tasks)
    members = members.withColumn("h", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK)))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.coalesce("text", F.lit("")).alias("text"))
    held = materialise(texts.join(F.broadcast(members) if few else members, "rep").coalesce(tasks), "bundles")
    found = materialise(_confirm(held, size, percent, tasks), "confirmed")
    large = held.where(F.col("size") > BLOCK)
    if not large.count():
        return found
    # A task links members to their component's first one, so leaders are those without such a link. They meet, in blocks again.
    fresh, leaders = found, large
    for turn in range(2):
        leaders = leaders.join(fresh.select(F.col("b").alias("rep")), "rep", "left_anti").coalesce(tasks)
        count = leaders.groupBy("g").agg(F.count(F.lit(1)).alias("leaders")).where("leaders > 1").coalesce(tasks)
        leaders = materialise(leaders.join(count, "g").withColumn("h", F.pmod(F.xxhash64("rep", F.lit(turn)), F.ceil(F.col("leaders") * F.col("weight") / BLOCK))).drop("leaders").coalesce(tasks), "leaders")
        if not leaders.count():
            return found
        fresh = materialise(_confirm(leaders, size, percent, tasks), "confirmed")
        found = found.unionByName(fresh)
    left = leaders.join(fresh.select(F.col("b").alias("rep")), "rep", "left_anti").groupBy("g").agg(F.count(F.lit(1)).alias("leaders")).where("leaders > 1")
    if not left.count():
        return found
    # Bundles in several components: all that are outside the largest one meet every block, by odd sketches first. What these join meets as texts.
    state = connected_components(found)
    label = materialise(_labelled(large.select("g", "rep", "weight"), state).coalesce(tasks), "unlinked")
    texts = large.select("rep", "text")
    odd = materialise(odd_sketches(texts.join(label.select("rep"), "rep"), size).coalesce(tasks), "odd-sketches")
    meet = _meeting(label.join(odd, "rep"), "odd", ODD_BLOCK)
    near = materialise(_odd_links(meet, percent).coalesce(tasks), "odd-links")
    finer = connected_components(near, first_tasks=tasks).select(F.col("node").alias("rep"), F.col("component").alias("finer"))
    rest = label.select("rep", "weight").join(finer, "rep")
    weights = rest.groupBy("finer").agg(F.avg("weight").alias("weight"))
    rest = materialise(_labelled(rest.drop("weight").join(weights, "finer").withColumnRenamed("finer", "g"), state).coalesce(tasks), "odd-bundles")
    meet = _meeting(rest.join(texts, "rep"), "text", BLOCK).dropDuplicates(["g", "h", "rep"])
    return materialise(found.unionByName(_confirm(meet, size, percent, tasks)), "confirmed")


def _labelled(members: DataFrame, state: DataFrame) -> DataFrame:
    """``members`` (g, rep, ...) of bundles in several components, with their component ``c``, and whether it isn't the bundle's largest."""
    label = members.join(state, members["rep"] == state["node"], "left").withColumn("c", F.coalesce("component", "rep")).drop("node", "component")
    comps = label.groupBy("g", "c").agg(F.count(F.lit(1)).alias("k"))
    whole = comps.groupBy("g").agg(F.max(F.struct("k", "c")).alias("m"), F.count(F.lit(1)).alias("comps"), F.sum("k").alias("members"))
    main = whole.where("comps > 1").select("g", F.col("m.c").alias("main"), "members", (F.col("members") - F.col("m.k")).alias("minors"))
    return label.join(main, "g").withColumn("minor", F.col("c") != F.col("main")).drop("main")


def _meeting(label: DataFrame, payload: str, block: int) -> DataFrame:
    """(g, h, side, rep, c, payload): every member with every minor one, in cells h of about ``block`` rows: side 0 are members, side 1 minor ones."""
    half = block // 2
    label = label.withColumns({"bx": F.ceil(F.col("members") * F.col("weight") / half), "by": F.ceil(F.col("minors") * F.col("weight") / half)})
    x, y = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("bx")), F.pmod(F.xxhash64("rep", F.lit(8)), F.col("by"))
    cells = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    as_block = label.withColumn("h", cells("by")).withColumn("h", x * F.col("by") + F.col("h")).withColumn("side", F.lit(0))
    as_minor = label.where("minor").withColumn("h", cells("bx")).withColumn("h", F.col("h") * F.col("by") + y).withColumn("side", F.lit(1))
    return as_block.unionByName(as_minor).select("g", "h", "side", "rep", "c", payload)


def odd_sketches(texts: DataFrame, size: int) -> DataFrame:
    """(rep, odd): the odd sketch of each text's set of n shingles: of 4 n to 8 n bits, a power of two, those that an odd number of shingles fall on."""

    def run(batches):
        for b in batches:
            for i, j, offsets, tokens in shingle_sets(b.column(1), size):
                made = []
                for lo, hi in zip(offsets, offsets[1:], strict=False):
                    bits = 1 << max(6, int(4 * (hi - lo)).bit_length())
                    words, at = np.zeros(bits // 64, np.uint64), tokens[lo:hi] >> np.uint64(13)
                    np.bitwise_xor.at(words, ((at & np.uint64(bits - 1)) >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
                    made.append(np.uint64(hi - lo).tobytes() + words.tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(made, pa.binary())], names=["rep", "odd"])

    return texts.mapInArrow(run, "rep long, odd binary")


def odd_near(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: int, percent: int) -> np.ndarray:
    """Which of the sketches ``a`` (rows of words; sets of ``n`` shingles) may be of sets with the similarity to that of ``b``. Each shingle in
    one of two sets alone turns one bit of the sketches' difference, so this has at most as many bits as there are such shingles: no link is lost."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64) * (100 + percent) <= (n + m) * (100 - percent)


def _odd_links(meet: DataFrame, percent: int) -> DataFrame:
    """(a, b): of each cell a spanning forest of the pairs from different components that may be links by their odd sketches."""

    def of_cell(side: np.ndarray, rep: np.ndarray, c: np.ndarray, odd: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([int.from_bytes(x[:8], "little") for x in odd])
        width = np.array([(len(x) - 8) // 8 for x in odd])
        left, right = [], []
        for w in np.unique(width):
            # Longer sketches are folded; two of these meet at a length of theirs.
            at = np.flatnonzero(width >= w)
            bits = np.array([np.bitwise_xor.reduce(np.frombuffer(odd[i], np.uint64, offset=8).reshape(-1, w)) for i in at])
            order = np.argsort(n[at], kind="stable")
            at, bits = at[order], bits[order]
            sizes, long_ = n[at], width[at] > w
            block = np.flatnonzero(side[at] == 0)
            for i in np.flatnonzero(side[at] == 1):
                lo, hi = np.searchsorted(sizes[block], [-(-sizes[i] * percent // 100), sizes[i] * 100 // percent + 1])
                near = block[lo:hi]
                near = near[(c[at[near]] != c[at[i]]) & ~(long_[near] & long_[i])]
                step = max(1, (4 << 20) // int(8 * w))
                for k in range(0, len(near), step):
                    some = near[k : k + step]
                    some = some[odd_near(bits[some], sizes[some], bits[i], int(sizes[i]), percent)]
                    left.append(np.full(len(some), rep[at[i]]))
                    right.append(rep[at[some]])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        nodes, ends = np.unique(np.concatenate([*left, *right]), return_inverse=True)
        half = len(ends) // 2
        label = _forest(ends[:half], ends[half:], len(nodes))
        linked = np.flatnonzero(label != np.arange(len(nodes)))
        return nodes[label[linked]], nodes[linked]

    def run(batches):
        for t in _grouped(batches, 2):
            at = 0
            for n in _counts_of(t.column(0).to_numpy(), t.column(1).to_numpy()):
                side, rep, c = (t.column(k).slice(at, n).to_numpy() for k in (2, 3, 4))
                a, b = of_cell(side, rep, c, t.column(5).slice(at, n).to_pylist())
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                at += n

    n = partitions(meet.sparkSession)
    return meet.repartition(n, "g", "h").sortWithinPartitions("g", "h").mapInArrow(run, "a long, b long")


def components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row. Rows that repeat a doc_id are one document, with the smallest
    of their texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
    if ids.where("k > 1").limit(1).count():
        whole = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text")).unionByName(docs.where("doc_id IS NULL"))
        one = _components(whole, size, percent)
        many = docs.where("doc_id IS NOT NULL").select("doc_id").join(one.where("doc_id IS NOT NULL"), "doc_id")
        return many.unionByName(one.where("doc_id IS NULL"))
    return _components(docs, size, percent)


def _components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    sets = materialise(profiles(docs, size), "sets")
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-sets.count() // ROWS_PER_TASK))
    with_id = sets.where("doc_id IS NOT NULL AND d1 IS NOT NULL")
    classes = with_id.groupBy("d1", "d2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    classes = materialise(classes.coalesce(tasks), "classes")
    reps = materialise(classes.select("rep", "n").join(with_id.select(F.col("doc_id").alias("rep"), "chosen", "sketch"), "rep").coalesce(tasks), "representatives")
    state = connected_components(links(docs.where("doc_id IS NOT NULL"), reps, size, percent, tasks), first_tasks=tasks).withColumnRenamed("node", "rep")
    # Only documents whose class has several rows or links need a join; all others are their own component.
    shared = classes.join(state, "rep", "left").where("rows > 1 OR component IS NOT NULL").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component")).coalesce(tasks)
    small = sets.select("doc_id", "n_shingles", "d1", "d2")
    full = small.where("d1 IS NOT NULL")  # empty sets have nothing to meet, and would meet in one task
    joined = full.join(shared, (full.d1 == shared.d1) & (full.d2 == shared.d2) & (full.n_shingles == shared.n), "left").select("doc_id", "n_shingles", "component")
    joined = joined.unionByName(small.where("d1 IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("component"), F.col("doc_id")))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")).coalesce(tasks)


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` that stay: one document of each component. Rows without id stay; rows that repeat an id share its fate."""
    gone = components(docs, size, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
