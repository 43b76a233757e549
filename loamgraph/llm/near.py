"""Near-duplicate classes by SetSketch registers: banded, estimated by likelihood, and verified on full sets.

1. Every whole text becomes its set of distinct five-word shingles (64-bit hashes) and a sketch of ``REGISTERS``
   one-byte registers: register i holds the truncated, exponentially spaced minimum over the set of an exponential
   variable per element (a marked Poisson process per element, so a set of n needs about n + m log m points).
   Sketches of unions are register-wise maxima.
2. Equal sets are one class from here on (a grouped minimum, however many copies).
3. ``BANDS`` bands of registers bucket the classes. In a bucket every class is compared with one centre only: the
   joint likelihood of the two sketches, given both set sizes, estimates their similarity. Estimates of ``TOUCH``
   or more hang the class on the centre. By the triangle inequality of the Jaccard distance, a class at ``CORE`` or
   more has no link to one below ``TOUCH``; what is not in the core meets again around the next centre, while the
   bucket still has classes below ``TOUCH``. After ``TURNS`` turns the rest is hung together unseen, so no pair of
   a bucket is lost.
4. A hung-together group larger than a block is cut down first (``refined``): only classes that share a shingle rare in
   the group, and whose sketches' estimate is ``CORE`` or more, stay together. Texts around a common passage fall apart
   here without being compared.
5. What hangs together then (a superset of the wanted components) is verified exactly: texts of a group meet in
   blocks of bounded size, and a breadth-first pass compares each full set with those not yet reached. A group
   larger than a block is first linked inside its blocks and through pilots that all its blocks share; only what is
   then outside its largest component meets all its blocks. Links become components by star contraction.

With 25 bands of 5 registers a pair at the threshold misses all bands with probability 2e-7.

Defined results: null, empty and blank texts have no shingle and stand alone; texts under five words are one
shingle; rows with a null id take no part: size as counted, component null, kept; equal texts share a component; a
repeated id is one document in the pipeline's stage (its first text in order stays) and each of its rows is
returned by ``near``; an empty table gives an empty result; extra columns are not looked at by ``near`` and kept
by ``deduplicated``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import components, scratch, store, table, written

WORDS = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
REGISTERS, BASE, BANDS, ROWS = 128, 1.12, 25, 5
CORE, TOUCH, TURNS = 0.6, 0.3, 4
#: Shingles of texts that are sketched together, about; one text may have more.
SKETCHED = 500_000
#: Classes and shingles of a block, pilots of a group.
BLOCK, MASS, PILOTS = 128, 2_000_000, 8
#: Classes of a large group whose shingles give its order; classes whose sketches are compared as they share a rare one.
SAMPLED, MATES = 64, 1024
_G = np.uint64(0x9E3779B97F4A7C15)


def mixed(z: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; ASCII capitals count as small letters."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    width = min(k, n)
    s = h[: n - width + 1].copy()
    for j in range(1, width):
        s *= _G
        s += h[j : n - width + 1 + j]
    return np.unique(mixed(s + np.uint64(width)))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per set."""
    m, docs = REGISTERS, len(sets)
    least = np.full((docs, m), np.inf)
    h = np.concatenate(sets) if docs else np.zeros(0, np.uint64)
    d = np.repeat(np.arange(docs), [len(s) for s in sets])
    x, step, names = np.zeros(len(h)), 0, np.arange(docs)
    work = least
    while len(h):
        step += 1
        z = mixed(h + np.uint64(step * int(_G) & 0xFFFFFFFFFFFFFFFF))
        x = x - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / m
        np.minimum.at(work.reshape(-1), d * m + (mixed(z ^ _G) >> np.uint64(57)).astype(np.int64), x)
        on = x < work.max(1)[d]  # the next point of an element comes later still
        h, d, x = h[on], d[on], x[on]
        if step >= 8 and step & (step - 1) == 0:  # go on with the few small sets that are not full yet
            left, d = np.unique(d, return_inverse=True)
            least[names] = work
            names, work = names[left], work[left]
    least[names] = work
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(np.log(20.0 / least) / np.log(BASE)), 0, 255).astype(np.uint8)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of largest joint likelihood, given the registers and the sizes of both sets."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - above - below
    u = (na / (na + nb))[:, None]
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    low, high = np.zeros((len(na), 1)), np.minimum(u / v, v / u)
    for _ in range(3):  # a grid, then finer ones around its best point
        j = low + (high - low) * np.linspace(0, 1, 17)
        pa_, pb = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        best = (above * np.log(pa_) + below * np.log(pb) + same * np.log(np.maximum(1 - pa_ - pb, 1e-12))).argmax(1)[:, None]
        low, high = np.take_along_axis(j, np.maximum(best - 1, 0), 1), np.take_along_axis(j, np.minimum(best + 1, 16), 1)
    return ((low + high) / 2)[:, 0]


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n (shingles), key (128-bit name of the set; null without shingles) and sketch of every row."""

    def run(batches):
        for batch in batches:
            first, sets, mass = 0, [], 0
            for k, text in enumerate(batch.column(1), 1):
                sets.append(shingles(text.as_py()))
                mass += len(sets[-1])
                if mass < SKETCHED and len(sets) < 1000 and k < len(batch):
                    continue
                regs = sketches(sets)
                keys = [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.record_batch([batch.column(0).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([r.tobytes() if len(s) else None for r, s in zip(regs, sets, strict=True)], pa.binary())], names=["doc_id", "n", "key", "sketch"])
                first, sets, mass = k, [], 0

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, key binary, sketch binary"), "sketched")


def bucketed(classes: DataFrame) -> DataFrame:
    """(bucket, cid): one row per class and band; a bucket is a band with its register values."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, REGISTERS)[:, : BANDS * ROWS].reshape(n, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)).copy()
            for r in range(ROWS):
                h = h * np.uint64(256) + regs[:, :, r]
            yield pa.record_batch([pa.array(mixed(h).view(np.int64).ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), BANDS))], names=["bucket", "cid"])

    return classes.select("cid", "sketch").mapInArrow(run, "bucket long, cid long")


def crowded(members: DataFrame) -> DataFrame:
    """The members of buckets of two or more, with the bucket's centre."""
    pick = F.min(F.struct(F.xxhash64("cid", F.lit(3)).alias("h"), "cid"))
    centres = members.groupBy("bucket").agg(pick.alias("c"), F.count("*").alias("n")).where("n > 1")
    centres = written(centres.select("bucket", F.col("c.cid").alias("centre")), "centres")
    return written(members.join(centres, "bucket").where("cid <> centre"), "crowded")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, centre, j) of distinct pairs: j is the estimate from both sketches."""
    side = lambda name, tag: classes.select(F.col("cid").alias(name), F.col("n").alias(f"n_{tag}"), F.col("sketch").alias(f"s_{tag}"))
    both = pairs.select("cid", "centre").distinct().join(side("cid", "a"), "cid").join(side("centre", "b"), "centre").select("cid", "centre", "n_a", "n_b", "s_a", "s_b")

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 8192):
                p = batch.slice(k, 8192)
                regs = [np.frombuffer(b"".join(p.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in (4, 5)]
                j = estimate(*regs, *(np.asarray(p.column(c), np.float64) for c in (2, 3)))
                yield pa.record_batch([p.column(0), p.column(1), pa.array(j)], names=["cid", "centre", "j"])

    return both.mapInArrow(run, "cid long, centre long, j double")


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(id, root) of classes that some likely chain of bucket-mates hangs together; roots are not listed."""
    found = None
    members = bucketed(classes)
    for turn in range(TURNS + 1):
        near = crowded(members)
        if near.isEmpty():
            break
        if turn == TURNS:
            edges = near.select(F.col("cid").alias("a"), F.col("centre").alias("b"))
        else:
            j = written(likely(near, classes), "likely")
            edges = j.where(F.col("j") >= TOUCH).select(F.col("cid").alias("a"), F.col("centre").alias("b"))
            seen = written(near.join(j, ["cid", "centre"]).where(F.col("j") < CORE).select("bucket", "cid", "j"), "seen")
            open_ = written(seen.where(F.col("j") < TOUCH).select("bucket").distinct(), "open")
            members = seen.join(open_, "bucket").select("bucket", "cid")
        found = edges if found is None else found.unionAll(edges)
        if turn == TURNS:
            break
    if found is None:
        return classes.sparkSession.createDataFrame([], "id long, root long")
    return components(found)


def linked(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None, ask: np.ndarray | None = None) -> np.ndarray:
    """A label per set: the smallest position that links reach. ``known``: labels that are linked already;
    ``ask``: only links of these sets are looked for."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(flat.max() + 1, np.int32)
    label = np.arange(n) if known is None else np.array([np.flatnonzero(known == k)[0] for k in known])

    def join(i: int) -> np.ndarray:
        mark[flat[at[i] : at[i] + size[i]]] = 1
        both = np.add.reduceat(mark[flat], at)
        mark[flat[at[i] : at[i] + size[i]]] = 0
        return 100 * both >= percent * (size + size[i] - both)

    if ask is not None:
        for i in np.flatnonzero(ask):
            for k in np.flatnonzero(join(i) & (label != label[i])):
                a, b = sorted((label[i], label[k]))
                label[label == b] = a
        return label
    left = np.ones(n, bool)
    for first in range(n):
        if not left[first]:
            continue
        left[first], queue = False, [first]
        while queue and left.any():
            new = np.flatnonzero(join(queue.pop()) & left)
            left[new] = False
            label[new] = first
            queue += new.tolist()
    return label


LINK = "a long, b long"


def hung(keys: np.ndarray, cids: np.ndarray, n: np.ndarray, regs: np.ndarray) -> tuple[list[int], list[int]]:
    """(cid, head) pairs that connect, within each run of equal ``keys``, what chains of estimates of ``CORE`` or more
    connect. Members are compared with the run's first one together, and the rest among themselves."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    head = np.repeat(start, np.diff(np.append(start, len(keys))))
    near = np.zeros(len(keys), bool)
    other = np.flatnonzero(head != np.arange(len(keys)))
    for k in range(0, len(other), 8192):
        i = other[k : k + 8192]
        near[i] = estimate(regs[i], regs[head[i]], n[i], n[head[i]]) >= CORE
    a, b = cids[near].tolist(), cids[head[near]].tolist()
    left = other[~near[other]]
    for first in np.unique(head[left]):
        run = np.arange(first, first + (head == first).sum())
        queue, open_ = run[near[run]].tolist(), run[1:][~near[run[1:]]]
        while len(open_):
            if queue:
                at = queue.pop()
            else:
                at, open_ = int(open_[0]), open_[1:]
            hit = estimate(np.broadcast_to(regs[at], (len(open_), regs.shape[1])), regs[open_], np.full(len(open_), n[at]), n[open_]) >= CORE
            a += cids[open_[hit]].tolist()
            b += [int(cids[at])] * int(hit.sum())
            queue += open_[hit].tolist()
            open_ = open_[~hit]
    return a, b


def refined(classes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(id, root): the groups of members(text, cid, root, sampled), cut down to classes that may link.

    Two sets that link share one of their rarest shingles: of n shingles the n - ceil(percent n / 100) + 1 that come first
    in any order of the group. The order puts last what many of its ``SAMPLED`` classes hold, so a passage that a whole group shares
    is no such shingle. Classes that share one are hung together where their sketches' estimate is ``CORE`` or more; a
    shingle that over ``MATES`` classes share hangs them together unseen, so no link is lost.
    """
    folder = scratch(classes.sparkSession, "common")

    def common(got: pa.Table) -> pa.Table:
        sets = [shingles(t) for t in got.column("text").to_pylist()]
        values, many = np.unique(np.concatenate(sets), return_counts=True)
        fs, base = store(folder)
        fs.create_dir(base, recursive=True)
        root = got.column("root")[0].as_py()
        with fs.open_output_stream(f"{base}/{root}") as f:
            f.write(values[many >= max(2, len(sets) // 16)].tobytes())
        return pa.table({"root": pa.array([root], pa.int64())})

    written(members.where("sampled").select("text", "root").groupBy("root").applyInArrow(common, "root long"), "common-done")

    def prefixes(batches):
        fs, base = store(folder)
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cids, roots, rows = batch.column("cid").to_pylist(), batch.column("root").to_pylist(), []
            for text, root in zip(batch.column("text").to_pylist(), roots, strict=True):
                if root not in held:
                    if len(held) > 64:
                        held.clear()
                    where = f"{base}/{root}"
                    held[root] = np.frombuffer(fs.open_input_stream(where).read() if fs.get_file_info(where).is_file else b"", np.uint64)
                s = shingles(text)
                often = np.isin(s, held[root])
                rows.append(np.concatenate([s[~often], s[often]])[: len(s) - -(-percent * len(s) // 100) + 1].view(np.int64))
            k = [len(x) for x in rows]
            yield pa.record_batch([pa.array(np.repeat(np.array(cids, np.int64), k)), pa.array(np.repeat(np.array(roots, np.int64), k)), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))], names=["cid", "root", "sh"])

    slim = written(members.select("text", "cid", "root").mapInArrow(prefixes, "cid long, root long, sh long"), "prefixes")
    live = written(slim.groupBy("root", "sh").agg(F.count("*").alias("many"), F.min("cid").alias("first")).where("many > 1"), "live")
    rows = slim.join(live.hint("merge"), ["root", "sh"])
    unseen = rows.where((F.col("many") > MATES) & (F.col("cid") != F.col("first"))).select(F.col("cid").alias("a"), F.col("first").alias("b"))
    seen = written(rows.where(F.col("many") <= MATES).select("root", "sh", "cid"), "shared")
    seen = seen.join(classes.select("cid", "n", "sketch").hint("merge"), "cid").select(F.xxhash64("root", "sh").alias("bucket"), "root", "sh", "cid", "n", "sketch")

    def runs(batches):
        held = None
        for batch in batches:
            got = pa.Table.from_batches([batch])
            held = got if held is None else pa.concat_tables([held, got])
            if not len(held):
                continue
            key = held.column("bucket").to_numpy()
            cut = int(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[-1])
            if cut:
                yield from stars(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None and len(held):
            yield from stars(held)

    def stars(got: pa.Table):
        # a hash may name two shingles, whose members are then compared as one run
        regs = np.frombuffer(b"".join(got.column("sketch").to_pylist()), np.uint8).reshape(-1, REGISTERS)
        a, b = hung(got.column("bucket").to_numpy(), got.column("cid").to_numpy(), got.column("n").to_numpy().astype(np.float64), regs)
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    edges = seen.repartition("root", "sh").sortWithinPartitions("bucket", "cid").mapInArrow(runs, LINK)
    return components(written(edges.unionAll(unseen).distinct(), "refined"))


def whole_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """classes(low, key, ...) with the text of each: the row of id ``low`` whose set has the name ``key``, as a repeated id
    may have other texts too. Texts are shuffled at every size, so a small run shows the plan of a large one."""
    texts = docs.select(F.col("doc_id").cast("long").alias("low"), "text").join(classes.hint("merge"), "low").select("text", *[c for c in classes.columns if c != "low"])
    at = texts.columns.index("key")

    def right(batches):
        for batch in batches:
            ok = [xxh3_128_digest(shingles(t).tobytes()) == k for t, k in zip(batch.column(0).to_pylist(), batch.column(at).to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return written(texts.mapInArrow(right, texts.schema).drop("key"), "texts")


def placed(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """cid, low, key, root, block, parts, pilot and sampled of every member of groups(id, root)."""
    roots = groups.select("root").distinct().select(F.col("root").alias("id"), "root")
    members = written(groups.unionByName(roots).withColumnRenamed("id", "cid").join(classes.select("cid", "low", "key", "n"), "cid"), "members")
    sizes = members.groupBy("root").agg(F.count("*").alias("many"), F.sum("n").alias("mass"))
    parts = F.greatest(F.ceil(F.col("many") / BLOCK), F.ceil(F.col("mass") / MASS)).cast("int")
    sizes = written(sizes.select(F.col("root").alias("r"), "many", parts.alias("parts")), "sizes")
    h = F.pmod(F.xxhash64("cid", F.lit(9)), F.lit(1 << 30))
    at = members.join(sizes, F.col("root") == F.col("r")).withColumn("block", F.pmod(F.xxhash64("cid", F.lit(5)), F.col("parts")).cast("int"))
    few = lambda n: (F.col("parts") > 1) & (h * F.col("many") < n * (1 << 30))
    return written(at.select("cid", "low", "key", "root", "block", "parts", few(PILOTS).alias("pilot"), few(SAMPLED).alias("sampled")), "placed")


def verified(docs: DataFrame, classes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between classes, enough of them to connect every component; all come from full sets."""
    texts = whole_texts(docs, placed(groups, classes))
    crowd = texts.where("parts > 1")
    if not crowd.isEmpty():
        finer = placed(refined(classes, crowd, percent), classes).drop("low", "key")
        moved = crowd.dropDuplicates(["cid"]).select("text", "cid").join(finer.hint("merge"), "cid").select(*texts.columns)
        texts = texts.where("parts = 1").unionByName(written(moved, "moved"))

    def sets_of(got: pa.Table):
        """Each class once, in the order of its number."""
        order = np.argsort(got.column("cid").to_numpy(), kind="stable")
        cids = got.column("cid").to_numpy()[order]
        order = order[np.concatenate([[True], cids[1:] != cids[:-1]])]
        got = got.take(pa.array(order))
        return got, got.column("cid").to_numpy(), [shingles(t) for t in got.column("text").to_pylist()]

    def inside(got: pa.Table) -> pa.Table:
        _, cids, sets = sets_of(got)
        label = linked(sets, percent)
        on = label != np.arange(len(label))
        return pa.table({"a": cids[on], "b": cids[label[on]]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    everywhere = F.when(F.col("pilot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("block"))
    first = texts.select("text", "cid", "root", F.explode(everywhere).alias("block"))
    links = written(first.groupBy("root", "block").applyInArrow(inside, LINK), "links-inside")
    large = written(texts.where("parts > 1"), "large")
    if large.isEmpty():
        return links
    # outside the largest component of a large group: these meet every block of it
    large_links = links.join(large.select(F.col("cid").alias("a")).distinct(), "a", "left_semi")
    comp = components(large_links)
    own = large.select("cid", "root").distinct().join(comp.withColumnRenamed("root", "c"), F.col("cid") == F.col("id"), "left").select("cid", "root", F.coalesce("c", "cid").alias("c"))
    own = written(own, "own")
    most = own.groupBy("root", "c").agg(F.count("*").alias("k")).groupBy("root").agg(F.max(F.struct("k", "c")).alias("m")).select("root", F.col("m.c").alias("main"))
    rest = written(own.join(written(most, "most"), "root").where("c <> main").select("cid"), "rest")
    if rest.isEmpty():
        return links
    big = large.select("text", "cid", "root", "block", "parts").dropDuplicates(["cid"]).join(own.select("cid", "c"), "cid")
    out = written(big.join(rest, "cid"), "outside")
    counts = written(out.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("turns")), "turns")
    asked = out.withColumn("ask", F.lit(True)).join(counts, "root").withColumn("turn", F.pmod(F.xxhash64("cid", F.lit(8)), F.col("turns")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # a block need only come where its members can be of another component: everywhere that something is asked
    met = big.withColumn("ask", F.lit(False)).join(counts, "root").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    cols = ["text", "cid", "root", "block", "turn", "c", "ask"]

    def across(got: pa.Table) -> pa.Table:
        got = got.sort_by([("cid", "ascending"), ("ask", "descending")])
        got, cids, sets = sets_of(got)
        known = got.column("c").to_numpy()
        label = linked(sets, percent, known, got.column("ask").to_numpy(zero_copy_only=False))
        on = cids[label] != cids
        return pa.table({"a": cids[on], "b": cids[label[on]]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    more = asked.select(cols).unionByName(met.select(cols)).groupBy("root", "block", "turn").applyInArrow(across, LINK)
    return links.unionAll(written(more, "links-across"))


def near(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = sketched(docs)
    known = rows.where("doc_id is not null and key is not null")
    classes = known.groupBy("key").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    groups = written(candidate_groups(classes), "groups")
    comp = components(verified(docs, classes, groups, percent)) if not groups.isEmpty() else groups
    named = classes.select("cid", "key", "low").join(comp, F.col("cid") == F.col("id"), "left").select("key", "low", F.coalesce("root", "cid").alias("root"))
    named = written(named, "named")
    least = written(named.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    found = written(named.join(least, "root").select("key", "component_id"), "found")
    out = rows.select("doc_id", "n", "key").join(found, "key", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay: one document of each component, all columns as they are. A repeated id is settled
    first: its other texts neither stay nor speak against other documents."""
    twice = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if not twice.isEmpty():
        first = docs.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNull(), "text")).alias("x")).select("x.*")
        docs = written(docs.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(first), "single")
    found = written(near(docs, percent).select("doc_id", "kept"), "near")
    gone = written(found.where("not kept").select("doc_id"), "gone")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def op6_near(spark, sf_dir) -> DataFrame:
    return near(table(spark, sf_dir, "documents"))
