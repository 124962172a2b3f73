"""MinHash near-dedup with HyperMinHash registers.

A document's set is its distinct 5-word shingles as 64-bit hashes.  The top seven bits
of a hash choose one of 128 buckets; of each bucket's least remaining hash a register
keeps the number of leading zeros and ten mantissa bits (two bytes).  Empty buckets
borrow from full ones by a fixed sequence of hashes, so short texts fill all registers.

1. Texts with equal sets are one class (128-bit digest of the set, partial sums).
2. Bands of four registers give each class 32 keys.  Classes that share a key are
   candidates: all pairs of a key held by up to ``SMALL`` classes, so few that they are no
   more than the classes; for a larger key (a bucket), a star: one class against all others.  The centre is the class whose keys are
   the commonest: the original of a group of copies is then the centre of nearly all of the
   group's buckets, and each copy meets it once.
3. Candidates pass a size test (exact) and the estimate of Jaccard similarity from the
   registers, corrected for chance collisions, with a margin of five standard errors of
   the registers that the smaller set fills.  The rest is verified on full shingle sets.
4. Components of the verified links.  A bucket that is one component is done: more links in
   it change nothing.  The others get a star from the commonest class outside the first
   centre's component; then members outside meet all others, if they are ``FEW``; else the
   bucket is held against itself in blocks, two blocks a task, where the same tests and the
   full sets decide and links alone are returned.  A pair is tested in the first key that it
   shares only, and a block is bounded in members (``CHUNK``) and hashes (``BLOCK_HASHES``).
   In a bucket above ``BLOCKED`` members two blocks meet only where they can hold a link that
   is missing: not two of the first star's component, and only blocks of sizes within 75 % of
   each other (both rules are exact).

So no step emits the pairs of a group, and a group of copies or near copies that its
star links costs its size, not its square; a bucket of many unlinked sets of like size
costs its square, in tasks of bounded size.  With registers that are independent, two
sets with similarity 0.75 share no key with probability 5e-6; in sets of few shingles
registers are borrowed, and it is larger.  Two sets that share a key are compared
whatever else holds that key; only the margin of five standard errors is not exact.
What is shuffled: 32 keys per distinct set, registers and full sets of candidates.

Defined results: null, empty and blank texts have 0 shingles and link with nothing;
fewer than five words are one shingle of their own length; long texts enter whole; rows
with the same ``doc_id`` are documents of their own and share an id; null ``doc_id``
stays null and never names a component unless all of it is null; an empty table gives
no rows; other columns are not read.  ``one_of_each`` decides by row (id and text), so
rows that share an id, rows without one and exact copies count as documents there.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precedent.llm.common import components, free_worker, materialize, small_batches, spread

WORDS = 5
# Fixed values of the contract: linked where 100 * intersection >= 75 * union.
PERCENT = 75
BUCKET_BITS = 7
N_REGISTERS = 1 << BUCKET_BITS
MANTISSA = 10
BAND = 4
N_BANDS = N_REGISTERS // BAND
#: Keys held by more are buckets: three classes make three pairs, more would make more pairs than classes.
SMALL = 3
FEW = 2
CHUNK = 500
BLOCK_HASHES = 1 << 20
BLOCKED = 1_000
#: Stars from further centres before large buckets are held against themselves.
STARS = 2


def _numbers(seed: int, n: int):
    import numpy as np

    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of a text, vectorised over its bytes."""

    def __init__(self, words: int = WORDS):
        import numpy as np

        self.np, self.words = np, words
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True        # the contract's white space
        self.space = space
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.powers = np.ones(1, np.uint64)
        self.weights = _numbers(11, words)

    def _powers(self, n):
        np = self.np
        if n > len(self.powers):
            grown = np.full(max(n, 2 * len(self.powers)), 0x9E3779B97F4A7C15, np.uint64)
            grown[0] = 1
            self.powers = np.multiply.accumulate(grown)
        return self.powers

    def __call__(self, text: str):
        np = self.np
        data = self.lower[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
        inside = ~self.space[data]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            return np.empty(0, np.uint64)
        lengths = ends - starts
        kept = data[inside].astype(np.uint64) + np.uint64(1)
        first = np.cumsum(lengths) - lengths
        within = np.arange(len(kept)) - np.repeat(first, lengths)
        words = _mix(np.add.reduceat(kept * self._powers(int(lengths.max()))[within], first)
                     + lengths.astype(np.uint64))
        n = len(words)
        if n < self.words:
            return _mix((words * self.weights[:n]).sum(keepdims=True) + np.uint64(n))
        total = np.zeros(n - self.words + 1, np.uint64)
        for k in range(self.words):
            total += words[k:n - self.words + 1 + k] * self.weights[k]
        return np.unique(_mix(total))


class Registers:
    """HyperMinHash registers of sorted hashes, and the estimate from two of them."""

    def __init__(self):
        import numpy as np

        self.np = np
        self.tries = [_mix(_numbers(100 + t, N_REGISTERS)) % np.uint64(N_REGISTERS) for t in range(64)]

    def __call__(self, hashes):
        np = self.np
        bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        rest = hashes[first] << np.uint64(BUCKET_BITS)      # the bucket's least hash, left-aligned
        width = np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]     # 53 bits, exact
        zeros = 53 - width
        mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        value = np.zeros(N_REGISTERS, np.int64)
        full = np.zeros(N_REGISTERS, bool)
        value[bucket[first]] = (zeros << MANTISSA) | mantissa.astype(np.int64)
        full[bucket[first]] = True
        if not full.all():
            have, missing = full.copy(), np.flatnonzero(~full)
            for t in range(1 << 30):
                # Past the stored tries, each bucket asks its followers in turn.
                ask = (self.tries[t][missing].astype(np.int64) if t < len(self.tries)
                       else (missing + t - len(self.tries) + 1) % N_REGISTERS)
                hit = have[ask]
                value[missing[hit]] = value[ask[hit]]
                missing = missing[~hit]
                if not len(missing):
                    break
        return value.astype(np.uint16)

    def keys(self, registers):
        """A 64-bit key per band; the band's number is part of it."""
        np = self.np
        bands = registers.reshape(N_BANDS, BAND).astype(np.uint64)
        packed = np.zeros(N_BANDS, np.uint64)
        for k in range(BAND):
            packed = (packed << np.uint64(16)) | bands[:, k]
        return _mix(_mix(packed) + np.arange(1, N_BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def chance_collision() -> float:
    """Probability that registers of unrelated sets agree: equal leading zeros (sum of
    4 ** -z, z >= 1) and equal mantissa."""
    return (1 / 3) * 2.0 ** -MANTISSA


def estimate(equal, n: int = N_REGISTERS):
    """Jaccard similarity from the number of equal registers, less chance collisions."""
    c = chance_collision()
    return (equal / n - c) / (1 - c)


def least_estimate(n):
    """Below this estimate no pair is verified whose smaller set has ``n`` shingles: 0.75 less
    five standard errors over the registers such a set is expected to fill by itself."""
    import numpy as np

    filled = N_REGISTERS * -np.expm1(-np.asarray(n, float) / N_REGISTERS)
    return PERCENT / 100 - 5 * np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / filled)


def text_hash() -> Column:
    """128 bits of the text; with ``doc_id`` it tells a row from all but its exact copies."""
    return F.unhex(F.md5("text"))


def sketch(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, n, d1, d2, registers, keys)`` for every row; the last four null without shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.binary()), ("n", pa.int64()), ("d1", pa.int64()),
                        ("d2", pa.int64()), ("registers", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        import numpy as np
        import xxhash

        free_worker()
        shingler, registers = Shingler(), Registers()
        for batch in small_batches(batches, "text"):
            rows = []
            for doc_id, th, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "th", "text")]):
                hashes = shingler(text or "")
                if not len(hashes):
                    rows.append((doc_id, th, 0, None, None, None, None))
                    continue
                d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), ">i8").tolist()
                r = registers(hashes)
                rows.append((doc_id, th, len(hashes), d1, d2, r.astype("<u2").tobytes(),
                             registers.keys(r).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)],
                                             schema=schema)

    return spread(docs.select("doc_id", "text")).withColumn("th", text_hash()).mapInArrow(
        run, "doc_id long, th binary, n long, d1 long, d2 long, registers binary, keys array<long>")


def full_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(cid, hashes)`` for ``classes(cid, first, d1, d2)``, from the text of each class's first row."""
    def run(batches):
        import numpy as np
        import xxhash

        free_worker()
        shingler = Shingler()
        for batch in small_batches(batches, "text"):
            rows = []
            for d1, d2, cid, text in zip(*[batch.column(c).to_pylist() for c in ("d1", "d2", "cid", "text")]):
                hashes = shingler(text or "")
                if len(hashes) and np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), ">i8").tolist() == [d1, d2]:
                    rows.append((cid, hashes.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.int64())))],
                    names=["cid", "hashes"])

    wanted = classes.select("cid", F.col("first.doc_id").alias("rep"), F.col("first.th").alias("rep_th"), "d1", "d2")
    rows = docs.select("doc_id", "text").withColumn("th", text_hash()).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("rep_th"))).drop("th", "rep_th")
    # Repeated rows of the table give a set twice.
    return rows.mapInArrow(run, "cid long, hashes array<long>").dropDuplicates(["cid"])


def promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that pass the size test and the estimate."""
    one = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    two = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    sized = pairs.join(one, "a").join(two, "b").where(
        100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))

    def run(batches):
        import numpy as np

        free_worker()
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, N_REGISTERS)
                      for c in ("ra", "rb"))
            n = np.minimum(batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            keep = pa.array(estimate((ra == rb).sum(1)) >= least_estimate(n))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return sized.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs linked by their full sets."""
    one = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("ha"))
    two = sets.select(F.col("cid").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(one, "a").join(two, "b").where(
        100 * both >= PERCENT * (F.size("ha") + F.size("hb") - both)).select("a", "b")


def size_steps(top: int = 1 << 40) -> list[int]:
    """Least sizes of steps so wide that sets with similarity 0.75 stand in the same or in neighbouring steps."""
    steps = [1]
    while steps[-1] <= top:
        steps.append(steps[-1] * 100 // PERCENT + 1)
    return steps


def blocked_links(members: DataFrame, payload: DataFrame, chunk: int = CHUNK, blocked: int = BLOCKED,
                  block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """Links ``(a, b)`` between different roots inside each key of ``members(key, cid, root, main, n)``
    (a written table: it is read three times), two blocks of a key at a time, enough of them to join the
    roots; ``payload(cid, registers, keys, hashes)`` holds each class once.
    ``main`` is the root of the star, the same for all of a key.  A block has about ``chunk``
    members and ``block_hashes`` hashes at most (or one larger set)."""
    steps = F.array(*[F.lit(s).cast("long") for s in size_steps()])
    # A part is twice the size step, plus one outside the star's component; small keys are one part.
    part = 2 * F.size(F.filter(steps, lambda s: s <= F.col("n"))) + (F.col("root") != F.col("main")).cast("int")
    held = members.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    parted = members.join(held, "key").withColumn(
        "part", F.when(F.col("held") > blocked, part).otherwise(1)).drop("held", "main")
    blocks = parted.groupBy("key", "part").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / chunk, F.sum("n") / block_hashes)).cast("int").alias("k"))
    blocks = blocks.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("part", "k"))).alias("blocks"))
    # Blocks are numbered (part, number within it); a block meets those of its own and the next step.
    meet = F.expr("""flatten(transform(filter(map_keys(blocks), p -> abs(p div 2 - part div 2) <= 1
        and (p % 2 = 1 or part % 2 = 1)), p -> transform(sequence(0, blocks[p] - 1), i -> struct(p as part, i as i))))""")
    met = (parted.join(blocks, "key").join(payload, "cid")
           .withColumn("own", F.struct("part", F.pmod(F.xxhash64("cid"), F.col("blocks")[F.col("part")]).cast("int").alias("i")))
           .withColumn("other", F.explode(meet))
           .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
           .withColumn("low", F.col("own") == F.col("lo")).withColumn("apart", F.col("lo") != F.col("hi"))
           .drop("blocks", "other", "part", "own"))

    def compare(table):
        import numpy as np

        table = table.sort_by([("n", "ascending"), ("cid", "ascending")])
        cid, n, own = (table.column(c).to_numpy() for c in ("cid", "n", "low"))
        hashes = table.column("hashes").combine_chunks()
        ends = hashes.offsets.to_numpy()
        # Sorted as unsigned numbers; views, not copies.
        flat = hashes.values.to_numpy().view(np.uint64)
        sets = [flat[i:j] for i, j in zip(ends, ends[1:])]
        key = table.column("key")[0].as_py()
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
        registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), "<u2").reshape(-1, N_REGISTERS)
        _, group = np.unique(table.column("root").to_numpy(), return_inverse=True)
        least, apart = least_estimate(n), table.column("apart")[0].as_py()
        found = []
        for i in range(len(cid)):
            # Sizes ascend, so partners stand between here and n / 0.75.
            j = np.arange(i + 1, np.searchsorted(PERCENT * n, 100 * n[i], "right"))
            j = j[group[j] != group[i]]
            if apart:
                j = j[own[j] != own[i]]
            if len(j):
                j = j[estimate((registers[j] == registers[i]).sum(1)) >= least[i]]
            if len(j):
                # A pair belongs to the first key that it shares; each of its keys comes here.
                j = j[keys[i][(keys[j] == keys[i]).argmax(1)] == key]
            for k in j.tolist():
                if group[k] != group[i]:
                    both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                    if 100 * both >= PERCENT * (n[i] + n[k] - both):
                        found.append((min(cid[i], cid[k]), max(cid[i], cid[k])))
                        group[group == group[k]] = group[i]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long")


class _Linker:
    """Verified links and the components they give, step by step."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes = docs, classes
        self.links, self.tried, self.sets, self.roots = [], [], [], None      # written tables

    @staticmethod
    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionAll(t)
        return out

    def load(self, cids: DataFrame) -> DataFrame:
        """The full sets of at least ``cids``, each computed once."""
        need = self.classes.select("cid", "first", "d1", "d2").join(cids, "cid", "left_semi")
        for known in self.sets:
            need = need.join(known, "cid", "left_anti")
        self.sets.append(materialize(full_sets(self.docs, need), "minhash-sets"))
        return self.union(self.sets)

    def add(self, links: DataFrame):
        """Keep new links; components anew if there are any."""
        links, stat = materialize(links, "minhash-links", {"n": F.count(F.lit(1))})
        self.links.append(links)
        if self.roots is None or stat["n"]:
            self.roots = materialize(components(self.union(self.links), "minhash"), "minhash-roots").select(
                F.col("id").alias("cid"), F.col("component").alias("root"))

    def check(self, pairs: DataFrame):
        """Verify ``pairs`` that were not tried before."""
        new = pairs.distinct()
        for tried in self.tried:
            new = new.join(tried, ["a", "b"], "left_anti")
        new = materialize(promising(new, self.classes), "minhash-pairs")
        self.tried.append(new)
        sets = self.load(new.select(F.col("a").alias("cid")).unionAll(new.select("b")).distinct())
        self.add(verified(new, sets))

    def compare(self, members: DataFrame):
        """Hold each key's ``members(key, cid, centre, n)`` against themselves, block by block."""
        centre = self.roots.select(F.col("cid").alias("centre"), F.col("root").alias("main"))
        members = self.rooted(members).join(centre, "centre", "left").select(
            "key", "cid", "root", F.coalesce("main", "centre").alias("main"), "n")
        open_ = members.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"))
        open_ = open_.where("least <> most").select("key")
        members, stat = materialize(members.join(open_, "key"), "minhash-blocked", {"n": F.count(F.lit(1))})
        if not stat["n"]:
            return
        cids = members.select("cid").distinct()
        payload = self.load(cids).join(self.classes.select("cid", "registers", "keys"), "cid").join(
            cids, "cid", "left_semi")
        self.add(blocked_links(members, payload, CHUNK, BLOCKED))

    def rooted(self, members: DataFrame) -> DataFrame:
        return members.join(self.roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def _small_pairs(members: DataFrame, buckets: DataFrame) -> DataFrame:
    few = members.join(buckets.where(f"held <= {SMALL}").select("key"), "key")
    other = few.select("key", F.col("cid").alias("b"))
    return few.select("key", F.col("cid").alias("a")).join(other, "key").where("a < b").select("a", "b")


def _star(members: DataFrame) -> DataFrame:
    """Per key of ``members(key, cid, common)``: the class whose keys are the commonest, the least of them."""
    return members.groupBy("key").agg(F.max_by("cid", F.struct("common", -F.col("cid"))).alias("centre"))


def _settle(linker: _Linker, members: DataFrame):
    """Work on ``members(key, cid, n)`` until no bucket can hold a link between two components."""
    members = materialize(members, "minhash-members")
    held = members.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    buckets, stat = materialize(held, "minhash-buckets", {"large": F.sum((F.col("held") > SMALL).cast("int"))})
    if not stat["large"]:
        linker.check(_small_pairs(members, buckets))
        return
    large = materialize(members.join(buckets.where(f"held > {SMALL}"), "key"), "minhash-large")
    # The original of a group of near copies holds the keys that most of them hold, so it is the centre
    # of nearly all their buckets, and each copy is compared with it once.
    common = large.groupBy("cid").agg(F.sum("held").alias("common"))
    large = materialize(large.select("key", "cid", "n").join(common, "cid"), "minhash-common")
    centres = materialize(_star(large), "minhash-centres")
    starred = large.join(centres, "key")
    linker.check(_small_pairs(members, buckets).unionAll(starred.where("cid <> centre").select(
        F.least("cid", "centre").alias("a"), F.greatest("cid", "centre").alias("b"))))
    for turn in range(STARS):
        # Buckets with members outside their first centre's component, and how many.
        main = linker.roots.select(F.col("cid").alias("centre"), F.col("root").alias("main"))
        now = materialize(linker.rooted(starred).join(main, "centre", "left").withColumn(
            "main", F.coalesce("main", "centre")), "minhash-rooted")      # read twice
        out = now.groupBy("key").agg(F.sum((F.col("root") != F.col("main")).cast("int")).alias("out")).where("out > 0")
        now, stat = materialize(now.join(out, "key"), "minhash-open", {"n": F.count(F.lit(1))})
        if not stat["n"]:
            return
        starred = now.select("key", "cid", "n", "common", "centre")
        if turn + 1 < STARS:
            # A further star from the commonest class outside.
            other = _star(now.where("root <> main")).withColumnRenamed("centre", "s")
            strays = now.where("root <> main")
        else:
            other, strays = None, now.where(f"root <> main and out <= {FEW}")
        strays = strays.select("key", F.col("cid").alias("s"), F.col("root").alias("s_root"))
        if other is not None:
            strays = strays.join(other, ["key", "s"])
        linker.check(now.join(strays, "key").where("root <> s_root").select(
            F.least("cid", "s").alias("a"), F.greatest("cid", "s").alias("b")))
    linker.compare(now.where(f"out > {FEW}").select("key", "cid", "centre", "n"))


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (``sketch``, written) and ``roots(cid, d1, d2, first, root)``: each class's component
    and its first row ``(no_id, doc_id, th)``, null ids last."""
    rows = materialize(sketch(docs), "minhash-rows")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    classes = rows.where("n > 0").groupBy("d1", "d2").agg(
        F.min(first).alias("first"), F.first("n").alias("n"), F.first("registers").alias("registers"),
        F.first("keys").alias("keys"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "minhash-classes")
    linker = _Linker(docs, classes)
    _settle(linker, classes.select(F.explode("keys").alias("key"), "cid", "n"))
    return rows, linker.rooted(classes.select("cid", "d1", "d2", "first"))


def near_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``."""
    rows, roots = _linked(docs)
    least = roots.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    named = roots.join(least, "root").select("d1", "d2", "component_id")
    linked = rows.where("n > 0").select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the least ``doc_id`` (null last), then
    the least text hash; of exact copies the least other columns.  Rows without shingles all stay."""
    rows, roots = _linked(docs)
    stays = roots.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("_id"), F.col("first.th").alias("_th"), F.lit(True).alias("_stays"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    texts = rows.where("n > 0").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("_copies"))
    # Rows that go, and rows that stay once of several copies, are left out; then one of the copies is added.
    out = materialize(texts.join(stays, same, "left").where("_stays is null or _copies > 1").select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "_stays"), "minhash-out")
    hashed = docs.withColumn("th", text_hash())
    single = hashed.join(out, same, "left_anti").select(*docs.columns)
    copies = hashed.join(out.where("_stays"), same, "left_semi")
    others = F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_none"))
    # Partial sums by input partition first, so that many copies are a few rows before they meet.
    one = (copies.groupBy("doc_id", "th", F.spark_partition_id().alias("_at"))
           .agg(F.first("text").alias("text"), F.min(others).alias("_others"))
           .groupBy("doc_id", "th").agg(F.first("text").alias("text"), F.min("_others").alias("_others")))
    return single.unionAll(one.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_others")[c].alias(c)
                                        for c in docs.columns]))
