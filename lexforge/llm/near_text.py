"""MinHash near-duplicates by an inverted join over signature coordinates.

1. A text's set is its distinct shingles, hashed; texts with equal sets form a class, and
   each class goes on as one representative.
2. A signature has ``coordinates`` least values. Each (coordinate, value) is a posting list.
   A pair at the threshold agrees in ``matches`` coordinates at least, but for a chance of
   half of ``miss`` (the exact binomial tail), so it shares one of any ``coordinates - matches + 1`` lists:
   representatives are posted under their rarest values only (prefix), and those whose
   values hardly occur elsewhere are skipped.
3. Every list's members meet the list's most central member first. Pairs that agree often
   enough are confirmed on the full sets, and their components are found.
4. Members of one list that are still in different components are counted coordinate by
   coordinate, in blocks, each pair at its first common list alone; pairs within a component
   are skipped, since they can change nothing, and so are pairs whose known distances to the
   list's central member differ by more than a link allows (distances of sets obey the
   triangle inequality). A longer sketch rules out most of the rest with the same rare
   misses. What passes is confirmed on full sets too.

So groups of near copies cost about as much as their size, and lists are never expanded
into pairs of one component. Tables between steps lie in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bound_batches, fresh, shingle_sets, slices, sorted_groups, text_words
from .graph import components


@dataclass(frozen=True)
class Near:
    """Link texts with 100 x intersection >= ``percent`` x union of their shingle sets."""

    percent: int = 80
    shingle: int = 5
    coordinates: int = 64
    sketch: int = 512
    block: int = 384

    miss: float = 1e-6

    def _bar(self, n: int, p: float) -> int:
        """The greatest count of agreements, of n with chance p each, that is missed with a chance of half of ``miss`` at most."""
        below, k = 0.0, 0
        while k < n:
            below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if below > self.miss / 2:
                break
            k += 1
        return max(1, k)

    @property
    def matches(self) -> int:
        return self._bar(self.coordinates, self.percent / 100)

    @property
    def sketch_matches(self) -> int:
        """The same for the sketch, whose bytes also agree by chance."""
        p = self.percent / 100
        return self._bar(self.sketch, p + (1 - p) / 256)

    @property
    def prefix(self) -> int:
        return self.coordinates - self.matches + 1


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _least(h: np.ndarray, first: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Least values of each run of shingles under n hash functions; zero for an empty run."""
    out = np.zeros((len(first) - 1, n), np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        for c, (a, x) in enumerate(zip(*_constants(n, seed))):
            v = (h ^ x) * a
            v ^= v >> np.uint64(32)
            v *= np.uint64(0x9E3779B97F4A7C15)
            out[full, c] = np.minimum.reduceat(v, first[:-1][full])
    return out


def signatures(h: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Tokens of each run of shingles: in column c, c in the top 6 bits, then the least value's lower 58; zero for an empty run."""
    least = _least(h, first, n, 20240229) & np.uint64((1 << 58) - 1)
    tokens = (least | (np.arange(n, dtype=np.uint64) << np.uint64(58))).view(np.int64)
    tokens[np.diff(first) == 0] = 0
    return tokens


def _names(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two numbers a run of shingles, by which its set is known; zero for an empty run."""
    full = np.diff(first) > 0
    keys = np.zeros((2, len(full)), np.uint64)
    if full.any():
        at = first[:-1][full]
        keys[0, full] = np.add.reduceat(h, at)
        keys[1, full] = np.bitwise_xor.reduceat(h * np.uint64(0xD6E8FEB86659FD93), at)
    return keys.view(np.int64)


def _signed(df: DataFrame, rule: Near) -> DataFrame:
    """(id, n, k1, k2, sig) of each row of (id, text); k1 and k2 name the set."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = shingle_sets(*text_words(part.column(1)), rule.shingle)
                n, keys = np.diff(first), _names(h, first)
                sig = pa.FixedSizeListArray.from_arrays(pa.array(signatures(h, first, rule.coordinates).reshape(-1)), rule.coordinates).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), sig], names=["id", "n", "k1", "k2", "sig"])

    return df.mapInArrow(run, f"id {kind}, n long, k1 long, k2 long, sig array<long>")


def _sets(df: DataFrame, rule: Near) -> DataFrame:
    """(rep, shingles, sketch) of rows (rep, text, k1, k2), as bytes: the sorted set, and one byte of each of more least values.

    A row whose text has another set than the one that k1 and k2 name is left out: its id has several texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = shingle_sets(*text_words(part.column(1)), rule.shingle)
                keys = _names(h, first)
                own = (keys[0] == part.column(2).to_numpy()) & (keys[1] == part.column(3).to_numpy())
                blobs = [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                sketch = [x.tobytes() for x in _least(h, first, rule.sketch, 19970611).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary()), pa.array(sketch, pa.binary())], names=["rep", "shingles", "sketch"]).filter(pa.array(own))

    return df.mapInArrow(run, f"rep {df.schema['rep'].dataType.simpleString()}, shingles binary, sketch binary")


def _measured(pairs: DataFrame, sets: DataFrame, rule: Near) -> DataFrame:
    """(a, b, distance, link) of pairs: one minus the similarity of the full sets, and whether it links them."""
    kind = pairs.schema["a"].dataType.simpleString()
    sets = sets.select("rep", "shingles")
    both = pairs.join(sets.withColumnsRenamed({"rep": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"rep": "b", "shingles": "y"}), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, good = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.sort(np.concatenate([p, q]))
                common = int((z[1:] == z[:-1]).sum())
                far.append(1 - common / (len(z) - common))
                good.append(100 * common >= rule.percent * (len(z) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far, pa.float64()), pa.array(good, pa.bool_())], names=["a", "b", "distance", "link"])

    return both.mapInArrow(run, f"a {kind}, b {kind}, distance double, link boolean")


def _agree(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)


def _across(lists: DataFrame, rule: Near) -> DataFrame:
    """Pairs (a, b) of one list and two components that agree often enough, each once.

    A list's largest component meets the others, and the others meet each other; both
    sides are cut into blocks. A list that is one component but for a few members costs
    as many rows as it has, times the few members' blocks.
    """
    sizes = lists.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("home"), F.max("n").alias("most"), F.sum("n").alias("all")).where("`all` > most")
    blocks = lambda n: F.ceil(n / rule.block).cast("int")
    rows = lists.join(sizes.select("token", "home", blocks(F.col("most")).alias("home_parts"), blocks(F.col("all") - F.col("most")).alias("parts")), "token")
    rows = rows.withColumn("at_home", F.col("component") == F.col("home"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.when(F.col("at_home"), F.col("home_parts")).otherwise(F.col("parts"))).cast("int"))
    # kind 0: block i of the largest component meets block j of the others; kind 1: blocks i <= j of the others
    key = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    part = F.col("part")
    abroad = F.concat(F.transform(upto("home_parts"), lambda k: key(0, k, part)), F.transform(upto("parts"), lambda k: key(1, F.least(part, k), F.greatest(part, k))))
    rows = rows.withColumn("key", F.explode(F.when(F.col("at_home"), F.transform(upto("parts"), lambda k: key(0, part, k))).otherwise(abroad)))
    keys = ["token", "kind", "i", "j"]
    rows = rows.select("token", "key.*", "part", "at_home", "rep", "component", "n", "sig", "mask", "distance", "sketch")
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        reach = 1 - rule.percent / 100 + 1e-9
        a_out: list[int] = []
        b_out: list[int] = []
        for table in sorted_groups(batches, keys):
            comp = table.column("component").to_numpy()
            if (comp == comp[0]).all():
                continue
            token, kind, i, j = (table.column(c)[0].as_py() for c in keys)
            coordinate = (token >> 58) & 63
            rep, n, part = (table.column(c).to_numpy() for c in ("rep", "n", "part"))
            sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(rep), -1)
            mask = (table.column("mask").to_numpy().view(np.uint64)[:, None] & bits[: sig.shape[1]]) != 0
            # distances of sets obey the triangle inequality; an unknown one (NaN) rules nothing out
            far = table.column("distance").to_numpy()
            if kind == 0:
                home = table.column("at_home").to_numpy()
                left, right = np.flatnonzero(~home), np.flatnonzero(home)
            else:
                left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
            byte = sig.astype(np.uint8)  # equal values have equal lowest bytes: most pairs are ruled out by an eighth of the data
            for x in left:
                y = right[right > x] if kind and i == j else right
                y = y[(comp[y] != comp[x]) & (100 * np.minimum(n[y], n[x]) >= rule.percent * np.maximum(n[y], n[x])) & ~(np.abs(far[y] - far[x]) > reach)]
                if len(y):
                    y = y[(byte[y] == byte[x]).view(np.uint8).sum(1, dtype=np.uint8) >= rule.matches]
                if len(y):
                    same = sig[y] == sig[x]
                    first = (same & mask[y] & mask[x]).argmax(1)
                    y = y[(same.sum(1) >= rule.matches) & (first == coordinate)]
                if len(y):
                    y = y[(sketch[y] == sketch[x]).sum(1) >= rule.sketch_matches]
                    a_out += np.minimum(rep[x], rep[y]).tolist()
                    b_out += np.maximum(rep[x], rep[y]).tolist()
            if len(a_out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
                a_out, b_out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Near = Near()) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row: its set's size, the smallest id
    reachable by links (its own included), and whether that is its own.

    Texts that are null or have no word have empty sets and link with nothing. A null id links
    with nothing, has a null component and is kept. Rows that repeat an id are classed each, by
    their own text; those of one text cost no more than one row once sets are made. Ids are integers. A pair at the very threshold links; of
    equal ids none is smaller, so there is no tie to break. An empty table gives an empty one.
    Other columns are dropped, so names cannot clash. A text is read whole: a worker holds a
    slice of texts or the longest one, with about 100 bytes a word of it.
    """
    space = Workspace(df.sparkSession, "near-text")
    bound_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = space.stow(_signed(docs, rule), "signed")

    sets = signed.where("id is not null and n > 0")
    classes = sets.groupBy("k1", "k2", "n").agg(F.min("id").alias("least"), F.first("sig").alias("sig"))
    classes = space.stow(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # numbers hold, since they are written
    tokens = classes.select("rep", F.explode("sig").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    found = tokens.join(common, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("posts"))  # one a coordinate at most
    found = found.where(F.size("posts") >= rule.matches)
    weight = F.aggregate("posts", F.lit(0.0), lambda s, p: s + F.log(p["df"].cast("double")))
    prefix = F.slice("posts", F.lit(1), F.size("posts") - (rule.matches - 1))  # values met nowhere else fill the rest of the prefix
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(p["token"], 58).cast("int"))
    mask = F.aggregate(prefix, F.lit(0).cast("long"), lambda s, p: s.bitwiseOR(bit(p)))
    found = space.stow(found.select("rep", weight.alias("weight"), prefix.alias("posts"), mask.alias("mask")).join(classes.select("rep", "n", "sig"), "rep"), "found")

    lists = found.select("rep", "n", "weight", F.explode("posts").alias("p")).select("rep", "n", "weight", "p.token")
    centre = lists.groupBy("token").agg(F.max_by(F.struct("rep", "n"), F.struct("weight", -F.col("rep"))).alias("c"))
    near = lists.join(centre, "token").where(F.col("rep") != F.col("c.rep"))
    near = near.where(100 * F.least("n", "c.n") >= rule.percent * F.greatest("n", "c.n")).select(F.col("rep").alias("a"), F.col("c.rep").alias("b")).distinct()
    sig = found.select("rep", "sig")
    near = near.join(sig.withColumnsRenamed({"rep": "a", "sig": "x"}), "a").join(sig.withColumnsRenamed({"rep": "b", "sig": "y"}), "b").where(_agree("x", "y") >= rule.matches).select("a", "b")
    # a hash of ids is built and texts stream by it: they need no sort
    wanted = found.select("rep").join(classes.select("rep", F.col("least").alias("id"), "k1", "k2"), "rep")
    texts = docs.join(wanted.hint("shuffle_hash"), "id").select("rep", "text", "k1", "k2")
    full = space.stow(_sets(texts, rule), "sets")
    if full.count() > found.count():  # repeated rows: one set a class goes on
        repeated, full = full, space.stow(full.dropDuplicates(["rep"]), "sets-once")
        space.drop(repeated)
    measured = space.stow(_measured(near, full, rule), "measured")
    links = measured.where("link").select("a", "b")

    groups = components(links, space).withColumnRenamed("node", "rep")
    members = found.join(groups, "rep", "left").select("rep", "n", "sig", "mask", "posts", F.coalesce("component", "rep").alias("component"))
    posted = members.select("rep", "n", "sig", "mask", "component", F.explode("posts").alias("p")).select("rep", "n", "sig", "mask", "component", "p.token")
    posted = posted.join(centre.select("token", F.col("c.rep").alias("b")), "token").join(measured.select(F.col("a").alias("rep"), "b", "distance"), ["rep", "b"], "left")
    posted = posted.withColumn("distance", F.when(F.col("rep") == F.col("b"), F.lit(0.0)).otherwise(F.coalesce("distance", F.lit(float("nan"))))).drop("b")
    posted = posted.join(full.select("rep", "sketch"), "rep")
    posted = space.stow(posted, "posted")
    more = space.stow(_measured(_across(posted, rule), full, rule), "more")
    for done in (posted, full, found):
        space.drop(done)
    groups = components(links.unionByName(more.where("link").select("a", "b")), space).withColumnRenamed("node", "rep")
    for done in (measured, more):
        space.drop(done)

    lowest = groups.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("lowest"))
    named = classes.select("k1", "k2", "n", "rep", "least").join(groups.join(lowest, "component").select("rep", "lowest"), "rep", "left")
    named = named.select("k1", "k2", "n", F.coalesce("lowest", "least").alias("component"))
    out = signed.select("id", "n", "k1", "k2").join(named.withColumnRenamed("n", "n2"), ["k1", "k2"], "left").where("n2 is null or n = n2 or n = 0")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def thin(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Near = Near()) -> DataFrame:
    """The rows of ``df`` whose document stays: one of each group, the smallest id; columns as they were, whatever their names.

    Rows with a null id, and rows whose text is null or has no word, stay. Rows that repeat an
    id stay or go together. An empty table gives an empty one.
    """
    gone = classify(df, id_col, text_col, rule).where("not kept").select(F.struct(F.col(id_col).alias("id")).alias(fresh(df, "gone"))).distinct()
    name = gone.columns[0]
    return df.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(name)["id"], "left_anti")
