"""Near-duplicates by HyperMinHash.

A document's shingle hashes are dealt into buckets; of the smallest in each bucket a 16-bit register
keeps the leading-zero count and the ten bits after it. An empty bucket takes the register of a full
one, chosen by a fixed random priority, so even the smallest sets fill all registers and two sets
agree in a register with the probability of their Jaccard similarity. Bands of registers are
hashed; documents that share a band are candidates. Their similarity is estimated from the share of
equal registers, less what equal registers by chance add; what may reach the threshold (``margin``
below it) is verified on the full sets.

Documents with equal sets are one class from the start, represented by their smallest id. Inside a
band's bucket nothing is paired with everything: first each member is compared with one pivot, the
central member that most of its bands agree on. That comparison also bounds what a member can share
with any third document, which closes most of those that aren't linked. Members still open are compared
with the pivots of their other bands. What then may still be linked across components shares a bucket,
hence the pivot of that bucket, and is searched by how it differs from that pivot (``_by_difference``): two
sets are similar only if they differ from it in the same way, an exact prefix filter over the
differences that leaves out what one member alone has. So a group of n copies costs about n
comparisons, and no link between different components is left out. With the defaults two documents at
the threshold share no band with probability 1e-6.

Defined results: a text without words has no shingles and no links; documents without an id
aren't linked (component null, kept); rows with the same id are one node: its sets are linked
through that id; an empty table gives an empty one; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import discard, join_few, join_hot, materialize, row_key, salts
from brindle.llm.components import components
from brindle.llm.shingles import _stream, mix, shingle_set


@dataclass(frozen=True)
class Sketch:
    bands: int = 50
    rows: int = 5
    shingle: int = 5
    percent: int = 75
    margin: float = 0.2
    #: Candidates (three longs each) are looked up by broadcast up to so many, else by a shuffle of those texts that a bit map doesn't rule out.
    broadcast_rows: int = 1_000_000

    @property
    def registers(self) -> int:
        return self.bands * self.rows


_priorities: dict[int, np.ndarray] = {}


def registers(hashes: np.ndarray, m: int) -> np.ndarray:
    """m registers of a non-empty set of hashes."""
    if m not in _priorities:
        _priorities[m] = _stream(11, m * m).astype(np.uint32).reshape(m, m)
    x = mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    bucket = ((x >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    value = mix(x) >> np.uint64(12)
    key = np.sort((bucket << np.uint64(52)) | value)
    bucket = (key >> np.uint64(52)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    part, exponent = np.frexp((key[first] & np.uint64((1 << 52) - 1)).astype(float))
    full = bucket[first]
    out = np.zeros(m, np.uint16)
    out[full] = ((52 - exponent).astype(np.uint16) << 10) | ((part * 2048).astype(np.int64) & 1023).astype(np.uint16)
    if len(full) < m:
        empty = np.setdiff1d(np.arange(m), full, assume_unique=True)
        out[empty] = out[full[_priorities[m][np.ix_(empty, full)].argmin(1)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, chance: float = 1 / 3072) -> float:
    """Jaccard similarity by equal registers, corrected by those that are equal by chance.

    Two independent registers have equal leading-zero counts with probability 1/3 and then equal
    mantissas with 2^-10.
    """
    return ((a == b).mean() - chance) / (1 - chance)


def sketch(docs: DataFrame, how: Sketch) -> DataFrame:
    """doc_id, n, c1, c2 (128 bits of the set) and registers; the latter three null for an empty set."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, c1, c2, regs = [], [], [], []
            for x in b.column(1):
                s = shingle_set(x.as_buffer().to_pybytes(), how.shingle)
                n.append(len(s))
                if len(s):
                    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8")
                    c1.append(int(d[0]))
                    c2.append(int(d[1]))
                    regs.append(registers(s, how.registers).astype("<u2").tobytes())
                else:
                    for c in (c1, c2, regs):
                        c.append(None)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "c1", "c2", "registers"])

    return _binary(docs).mapInArrow(run, "doc_id long, n long, c1 long, c2 long, registers binary")


def _binary(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def payloads(docs: DataFrame, needed: DataFrame, how: Sketch) -> DataFrame:
    """id, registers and payload (the full set) of each class in needed (id, c1, c2)."""
    import pyarrow as pa

    needed = materialize(needed, "needed")
    texts = _binary(docs).where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "id")
    src = texts.join(F.broadcast(needed), "id") if needed.count() <= how.broadcast_rows else join_few(texts, needed, "id", "inner")
    src = src.select("id", "text", "c1", "c2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, regs, sets = [], [], []
            for i, x, c1, c2 in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                s = shingle_set(x.as_buffer().to_pybytes(), how.shingle)
                d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8")
                if (int(d[0]), int(d[1])) == (c1, c2):  # rows with the same id may have other texts
                    ids.append(i)
                    regs.append(registers(s, how.registers).tobytes())
                    sets.append(s.tobytes())
            cols = [pa.array(ids, pa.int64()), pa.array(regs, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "registers", "payload"])

    return src.mapInArrow(run, "id long, registers binary, payload binary")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs with registers (ra, rb) and sets (pa, pb) of a and b; b may be the pivot of very many a."""
    side = lambda k: sets.select(F.col("id").alias(k), F.col("registers").alias(f"r{k}"), F.col("payload").alias(f"p{k}"))
    pairs = materialize(pairs, "pairs")
    pivots = side("b").join(pairs.groupBy("b").agg(salts("a")), "b")
    return join_hot(pairs.join(side("a"), "a"), pivots, ["b"], "a")


PAIR = "a long, b long, linked boolean, n long, common long, added array<long>"


def compare(pairs: DataFrame, sets: DataFrame, how: Sketch, details: bool = False) -> DataFrame:
    """PAIR rows of pairs (a, b); sets: id, registers, payload. Estimated first, verified on full sets where that leaves it open.

    details: also n, the size of a's set, how much of it is common with b's, and the hashes that are not; else
    these are null and only linked pairs come back.
    """
    import pyarrow as pa

    both = _with_sets(pairs, sets).select("a", "b", "ra", "rb", "pa", "pb")

    def possible(ra, rb, x, y) -> bool:
        small, large = sorted((len(x), len(y)))
        if 100 * small < how.percent * large:
            return False
        return small < 64 or estimate(ra, rb) >= how.percent / 100 - how.margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, j, *four in zip(*(batch.column(k).to_pylist() if k < 2 else batch.column(k) for k in range(6))):
                ra, rb, x, y = (np.frombuffer(z.as_buffer(), np.uint16 if k < 2 else np.uint64) for k, z in enumerate(four))
                can = possible(ra, rb, x, y)
                if not can and not details:
                    continue
                added = np.setdiff1d(x, y, assume_unique=True)
                common = len(x) - len(added)
                linked = can and 100 * common >= how.percent * (len(x) + len(y) - common)
                if details:
                    rows.append((i, j, linked, len(x), common, added.view(np.int64).tolist()))
                elif linked:
                    rows.append((i, j, True, None, None, None))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["a", "b", "linked", "n", "common", "added"])

    return both.mapInArrow(run, PAIR)


def _hashes(sets: DataFrame) -> DataFrame:
    """owner and each hash g of its set."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                g = np.frombuffer(x.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i), pa.int64()), pa.array(g)], ["owner", "g"])

    return sets.select("id", "payload").mapInArrow(run, "owner long, g long")


def closed(compared: DataFrame, sets: DataFrame, how: Sketch) -> DataFrame:
    """id of those among compared (PAIR with details, each a once) that can have no link but that with their b.

    What a shares with any other document is common with b or else a hash that this other document (whole, if it
    was compared with none) or the one it was compared with holds as well; so it is at most the common part and the hashes outside of it
    that have a second owner. If that is too little of a, no other document is similar enough.
    """
    outside = compared.select(F.col("a").alias("owner"), F.explode("added").alias("g"))
    # Whole sets of pivots, and of members that were compared with none as they are the pivot of all their buckets.
    alone = sets.select("id").join(compared.select(F.col("a").alias("id")), "id", "left_anti")
    whole = compared.select(F.col("b").alias("id")).union(alone).distinct()
    owners = outside.unionByName(_hashes(sets.join(whole, "id", "left_semi"))).groupBy("g").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"))
    several = owners.where(F.col("lo") < F.col("hi")).select("g")
    shared = outside.join(several, "g", "left_semi").groupBy("owner").agg(F.count(F.lit(1)).alias("shared"))
    most = F.col("common") + F.coalesce("shared", F.lit(0))
    bound = compared.select(F.col("a").alias("owner"), "n", "common").join(shared, "owner", "left")
    return bound.where(100 * most < how.percent * F.col("n")).select(F.col("owner").alias("id"))


def _with_components(df: DataFrame, comps: DataFrame, *cols: str) -> DataFrame:
    """df with the component of each of cols as c_<col>."""
    for c in cols:
        own = comps.select(F.col("id").alias(c), F.col("component").alias("_c"))
        df = df.join(own, c, "left").withColumn(f"c_{c}", F.coalesce("_c", c)).drop("_c")
    return df


def buckets(reps: DataFrame, how: Sketch) -> DataFrame:
    """h, rep and size of the bands that several of the classes in reps (rep, registers) share."""
    width = 2 * how.rows
    each = F.transform(F.sequence(F.lit(0), F.lit(how.bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * width + 1, F.lit(width))))
    bands = reps.select("rep", F.explode(each).alias("h"))
    several = bands.groupBy("h").agg(F.count(F.lit(1)).alias("size"), salts("rep")).where("size > 1")
    return materialize(join_hot(bands, several, ["h"], "rep"), "buckets")


def class_links(docs: DataFrame, reps: DataFrame, members: DataFrame, how: Sketch) -> DataFrame:
    """Links (a, b) between the classes in reps (rep, c1, c2) that give their components; members: their buckets."""
    # The pivot of a bucket is the member with the most company in all its buckets: of a group of edited copies, the original.
    degree = members.groupBy("rep").agg(F.sum("size").alias("degree"))
    members = members.drop("size").join(degree, "rep")
    pivot = members.groupBy("h").agg(F.max(F.struct("degree", (-F.col("rep")).alias("rep"))).alias("p"), salts("rep"))
    pivot = pivot.select("h", (-F.col("p.rep")).alias("pivot"), "_salts")
    members = materialize(join_hot(members.drop("degree"), pivot, ["h"], "rep"), "members")
    tries = members.where(F.col("rep") != F.col("pivot")).groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("bands"))
    tries = materialize(tries.select(F.col("rep").alias("a"), F.col("pivot").alias("b"), "bands"), "tries")
    needed = reps.join(members.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("id"), "c1", "c2")
    sets = materialize(payloads(docs, needed, how), "sets")
    # The pivot that most bands agree on.
    best = tries.groupBy("a").agg(F.max(F.struct("bands", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b"))
    compared = materialize(compare(best, sets, how, details=True), "compared")
    done = materialize(closed(compared, sets, how), "closed")
    links = materialize(compared.where("linked").select("a", "b"), "links")
    discard(compared)
    # The other pivots, where they lie in another component.
    comps = components(links)
    is_open = lambda df, c: df.join(done.withColumnRenamed("id", c), c, "left_anti")
    open_tries = materialize(is_open(tries, "a").select("a", "b"), "open-tries")
    other = is_open(_with_components(open_tries, comps, "a", "b").where(F.col("c_a") != F.col("c_b")), "b").select("a", "b")
    other = other.join(best, ["a", "b"], "left_anti")
    links = materialize(links.union(compare(other, sets, how).select("a", "b")), "links")
    # Members of one pivot that lie in several components.
    members = materialize(_with_components(open_tries, components(links), "a", "b"), "components-of-pivots")
    mixed = members.groupBy("b").agg(F.min("c_a").alias("lo"), F.max("c_a").alias("hi"), salts("a")).where(F.col("lo") < F.col("hi"))
    members = join_hot(members, mixed.drop("lo", "hi"), ["b"], "a")
    left = _by_difference(differences(members, sets), how).join(tries.select("a", "b"), ["a", "b"], "left_anti")
    links = links.union(materialize(compare(left, sets, how).select("a", "b"), "links"))
    discard(sets)
    return links


DIFFERENCE = "a long, pivot long, c long, inside boolean, size long, missing long, added long, bits array<long>, differs array<long>"


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """How the set of each a differs from that of its pivot b: DIFFERENCE rows of members (a, b, c_a, c_b).

    size: of the pivot's set; missing and added: hashes of the pivot that a lacks, and the others of a; bits: parity of
    the differing hashes in 256 bits, so that two differences in k hashes have at most k other bits.
    """
    import pyarrow as pa

    names = [x.split()[0] for x in DIFFERENCE.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, c, inside, x, y in zip(*(batch.column(k).to_pylist() if k < 4 else batch.column(k) for k in range(6))):
                own, pivot = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                d = np.setxor1d(own, pivot, assume_unique=True)
                common = (len(own) + len(pivot) - len(d)) // 2
                bit = mix(d)
                bits = np.zeros(4, np.uint64)
                np.bitwise_xor.at(bits, (bit & np.uint64(3)).astype(np.int64), np.uint64(1) << ((bit >> np.uint64(2)) & np.uint64(63)))
                rows.append((a, b, c, inside, len(pivot), len(pivot) - common, len(own) - common, bits.view(np.int64).tolist(), d.view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(names), kinds)], names)

    inside = (F.col("c_a") == F.col("c_b")).alias("inside")
    return _with_sets(members, sets).select("a", "b", "c_a", inside, "pa", "pb").mapInArrow(run, DIFFERENCE)


def _by_difference(members: DataFrame, how: Sketch) -> DataFrame:
    """Pairs (a, b; a the larger id) of members (DIFFERENCE) of one pivot but of two components that can be similar.

    With t the threshold and R the pivot's set, x and y have |R| - missing(x) - missing(y) + (what they differ from R in
    alike) hashes in common, so they are similar exactly if they differ alike in at least
    w(x) + w(y) - |R| (1 - t) / (1 + t) hashes, w = (missing + t added) / (1 + t). A member that isn't linked with the
    pivot has w > |R| (1 - t) / (1 + t), so at least one hash is asked of all pairs of different components.
    Hashes in which a member differs alone can't be among those; of the others, put in order of how many share them, one
    of the first size - needed + 1 of x and of y must be shared (prefix filter), and the bits
    bound what is alike as well. All of it in integers, times 100 (1 + t).
    """
    members = materialize(members, "differences")
    unit = 100 + how.percent
    each = members.select("a", "pivot", F.explode("differs").alias("g"))
    shared = each.groupBy("pivot", "g").agg(F.count(F.lit(1)).alias("owners"), salts("a")).where("owners > 1")
    alike = join_hot(each, shared, ["pivot", "g"], "a").groupBy("a", "pivot").agg(F.sort_array(F.collect_list(F.struct("owners", "g"))).alias("alike"))
    rows = members.drop("differs").join(alike, ["a", "pivot"]).withColumn("w", 100 * F.col("missing") + how.percent * F.col("added"))
    rows = rows.withColumns({"free": (100 - how.percent) * F.col("size"), "differ": F.col("missing") + F.col("added"), "last": F.size("alike") + F.lit(1)})
    # Places (from 1) that can be in a prefix: if the partner is outside of the pivot's component, or else inside.
    most = F.col("last") * unit - F.col("w") + F.when(F.col("inside"), 0).otherwise(F.col("free"))
    first = F.slice("alike", 1, F.greatest(F.lit(0), F.least(F.col("last") - 1, F.floor(most / unit))).cast("int"))
    rows = rows.select("a", "pivot", "c", "inside", "w", "free", "differ", "last", "bits", F.posexplode(first).alias("at", "own"))
    rows = materialize(rows.select("pivot", F.col("own.g").alias("g"), (F.col("at") + 1).alias("at"), "a", "c", "inside", "w", "free", "differ", "last", "bits"), "prefixes")
    discard(members)
    side = lambda df, k: df.select("pivot", "g", *(F.col(c).alias(f"{c}_{k}") for c in ("at", "a", "c", "w", "free", "differ", "last", "bits")))
    x = side(rows.where("NOT inside"), "x")
    y = side(rows.where((F.col("last") - F.col("at")) * unit > F.col("w")), "y")
    need = F.col("w_x") + F.col("w_y") - F.col("free_x")
    other_bits = sum((F.bit_count(F.col("bits_x")[i].bitwiseXOR(F.col("bits_y")[i])) for i in range(4)), F.lit(0))
    can = (F.col("a_x") != F.col("a_y")) & (F.col("c_x") != F.col("c_y"))
    for k in "xy":
        can &= (F.col(f"last_{k}") - F.col(f"at_{k}")) * unit >= need
    can &= unit * (F.col("differ_x") + F.col("differ_y") - other_bits) >= 2 * need
    pairs = x.join(y, ["pivot", "g"]).where(can)
    return pairs.select(F.greatest("a_x", "a_y").alias("a"), F.least("a_x", "a_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, how: Sketch = Sketch()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of docs (doc_id, text)."""
    sketches = materialize(sketch(docs, how), "sketch")
    is_linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    classes = sketches.where(is_linked).groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers"))
    classes = materialize(classes, "classes")
    # Registers, most of what is written here, go as soon as they are dealt into buckets.
    all_of = materialize(sketches.drop("registers"), "set-sizes")
    discard(sketches)
    linked = all_of.where(is_linked)
    members = buckets(classes, how)
    reps = materialize(classes.drop("registers"), "class-ids")
    discard(classes)
    links = class_links(docs, reps, members, how)
    member = linked.select("doc_id", "c1", "c2").join(reps.select("c1", "c2", "rep"), ["c1", "c2"]).select("doc_id", "rep")
    member = materialize(member, "membership")
    # An id whose rows are of several classes links them.
    several = member.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where(F.col("lo") < F.col("hi"))
    through = member.join(several, "doc_id").where(F.col("rep") != F.col("lo")).select(F.col("rep").alias("a"), F.col("lo").alias("b"))
    comps = components(links.union(through))
    of_id = _with_components(member.groupBy("doc_id").agg(F.min("rep").alias("rep")), comps, "rep").select("doc_id", F.col("c_rep").alias("component_id"))
    out = all_of.select("doc_id", F.col("n").alias("n_shingles")).join(of_id, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, how: Sketch = Sketch()) -> DataFrame:
    """docs without the near-copies: of each component the row with the smallest id stays, one of them if rows repeat its id and text.

    A row without an id takes part by one made of its text, larger than real ones; so it goes if a document with an id is like it.
    """
    made = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2).bitwiseOR(F.lit(1 << 62))
    docs = docs.drop("_id", "_row").withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), made))
    own = docs.select(F.col("_id").alias("doc_id"), "text")
    gone = materialize(near_duplicates(own, how).where(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct(), "near-copies")
    left = join_few(docs, gone, "_id", "left_anti").withColumn("_row", row_key("_id"))
    twice = own.select(row_key().alias("_row")).groupBy("_row").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_row")
    twice = materialize(twice, "repeated-rows")
    if not twice.isEmpty():
        # Texts of repeated rows alone are shuffled.
        left = left.join(twice, "_row", "left_anti").unionByName(left.join(twice, "_row", "left_semi").dropDuplicates(["_row"]))
    return left.drop("_id", "_row")


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
