"""Every operator against brute force, and its defined results on odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from precedent.llm import (op1_suffix, op2_toxicity, op3_mix, op4_secrets, op5_pack, op6_fingerprints,
                           op7_embeddings, op8_lines, op9_minhash, op10_binary)
from precedent.llm.common import components
from precedent.llm.suffixes import repeated_starts, suffix_array

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n, vocabulary=5_000):
    return " ".join(f"word{rng.randrange(vocabulary)}" for _ in range(n))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# ---------------------------------------------------------------- 1
def brute_repeats(rows, length):
    seen = collections.Counter(b[p:p + length] for b in rows for p in range(len(b) - length + 1))
    out = []
    for b in rows:
        cov = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                cov[p:p + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cov) if not c)
        out.append((len(b), sum(cov), len(re.findall(b"\1+", bytes(cov))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(100):
        d = rng.integers(0, rng.integers(1, 5), rng.integers(1, 150)).astype(np.uint8)
        b = d.tobytes()
        assert suffix_array(d, 400).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    d = np.frombuffer(b"abcabcab-abcabx", np.uint8)
    assert repeated_starts(d, np.arange(len(d)) <= len(d) - 8, 8).tolist() == []


@pytest.mark.parametrize("kw", [{}, {"max_bin": 1, "block": 2_000}, {"max_bin": 1, "grams": (128,)}])
def test_suffix_dedup_equals_brute_force(make, kw):
    rng = random.Random(5)
    passage = words(rng, 90)
    rows = [(i, words(rng, 40) + " " + passage[rng.randrange(40):] + words(rng, 30)) for i in range(12)]
    rows += [(20, rows[0][1]), (21, "z" * 900), (22, words(rng, 30) * 3), (23, None), (24, "short")]
    want = brute_repeats([(t or "").encode() for _, t in rows], 400)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in op1_suffix.remove_repeats(make(rows), **kw).collect()}
    assert got == {i: w for (i, _), w in zip(rows, want)}


def test_suffix_dedup_odd_rows(spark, odd):
    got = op1_suffix.remove_repeats(odd).collect()
    assert len(got) == 9 and op1_suffix.remove_repeats(empty(spark)).count() == 0
    assert all(r.n_bytes == 0 for r in got if r.doc_id in (1, 2, 7))


# ---------------------------------------------------------------- 2
def test_toxicity_learns_clauses(spark, make):
    rng = random.Random(1)
    rows = [(i, words(rng, 30) + (f". you total grumpkin{rng.choice(['', 's', 'ed'])} there." if i % 4 == 0 else ".")
             + words(rng, 20)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5000, 0)],
                                   "doc_id long, toxic int")
    got = op2_toxicity.toxicity(make(rows), labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.97


def test_toxicity_grammar_factors():
    g = op2_toxicity.Grammar({"oaf": 5.0})
    plain, aimed, negated, told = (g.features(t)[0] for t in
                                   ("the oaf.", "you oaf.", "not an oaf.", "she said the oaf"))
    assert negated < told < plain < aimed and g.features("I will kill. Nice.")[0] > 0
    assert g.features(None) == g.features("kill time") == (0.0, 0.0, 0.0, 0.0)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = op2_toxicity.toxicity(odd, labels).collect()
    assert len(got) == 9 and {r.score for r in got} == {0.0}
    assert op2_toxicity.toxicity(empty(spark), labels).count() == 0


# ---------------------------------------------------------------- 3
def test_mix_targets_and_limits(spark, make):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(60)), "en", random.Random(i).choice(["a", "b", "b", "b", None, "c"]))
            for i in range(300)] + [(900, words(rng, 4), "en", "tiny")]
    got = op3_mix.mix(make(rows)).collect()
    assert [r.taken for r in sorted(got, key=lambda r: r.doc_id)] == [
        r.taken for r in sorted(op3_mix.mix(make(rows, 7)).collect(), key=lambda r: r.doc_id)]
    by = collections.defaultdict(list)
    src = {r[0]: r[3] for r in rows}
    for r in got:
        assert r.taken <= 3 * r.size and (not r.size or len(r.shards) == r.repeats + (r.part > 0))
        by[src[r.doc_id]].append(r)
    total = sum(r.size for r in got)
    assert abs(sum(rs[0].target for rs in by.values()) - total) < 1e-6
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 1
    assert by["tiny"][0].target == 12


def test_mix_odd_rows(spark, odd):
    assert op3_mix.mix(odd).count() == 9 and op3_mix.mix(empty(spark)).count() == 0


# ---------------------------------------------------------------- 4
def test_secret_spans(make):
    key = "q8Zr2Lk0Vx9Tn4Wb7Hs1Yd6Mf3"
    rows = [(i, f"Password: \"hunter{i}xyz9Qk7Lm2\" and AKIA{'Z9Q4' * 4} hash {hashlib.md5(str(i).encode()).hexdigest()} "
                + words(random.Random(i), 40).replace("word", "ordinary_identifier_")) for i in range(60)]
    rows += [(100, f"loose {key} here"), (101, "the internationalization_helpers module"), (102, "token: abc"), (103, None)]
    got = {r.doc_id: r for r in op4_secrets.find_secrets(make(rows)).collect()}
    r, text = got[3], rows[3][1]
    spans = [x.split(":") for x in r.spans.split(",")]
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 1, 1)
    assert text[int(spans[0][1]):int(spans[0][2])] == 'Password: "hunter3xyz9Qk7Lm2'
    base = ",".join(":".join(s) for s in spans if s[0] != "random")
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[100].spans == f"random:6:{6 + len(key)}" and got[101].spans == got[102].spans == ""
    assert got[103].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_secrets_odd_rows(spark, odd):
    assert op4_secrets.find_secrets(odd).count() == 9 and op4_secrets.find_secrets(empty(spark)).count() == 0


# ---------------------------------------------------------------- 5
def ids_of(text, end):
    t = Tokenizer.from_file(TOKENIZER)
    return np.asarray(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing_covers_every_id(make, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = op5_pack.pack(odd, TOKENIZER).collect()
    want = collections.Counter()
    for doc, text in rows:
        want[(doc, len(ids_of(text, 1)))] += len(ids_of(text, 1))
    have, seq = collections.Counter(), collections.defaultdict(list)
    for r in got:
        ids = next(ids_of(t, 1) for d, t in rows if d == r.doc_id and len(ids_of(t, 1)) == r.doc_tokens) \
            if r.doc_id != 4 else None
        if ids is not None:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        have[(r.doc_id, r.doc_tokens)] += r.length
        seq[r.sequence_id].append(r)
    assert have == want
    for rs in seq.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == list(itertools.accumulate([0] + [r.length for r in rs]))[:-1]
        assert sum(r.length for r in rs) <= 2048


def test_karmarkar_karp_is_near_equal():
    rng = random.Random(3)
    sizes = [rng.randrange(1, 512) for _ in range(300)]
    parts = op5_pack.karmarkar_karp(sizes, 30)
    assert sorted(i for p in parts for i in p) == list(range(300))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) < 40
    assert all(sum(sizes[i] for i in w) <= 2048 for w in op5_pack.pack_group(sizes, 2048))


def test_packing_empty_table(spark):
    assert op5_pack.pack(empty(spark), TOKENIZER).count() == 0


# ---------------------------------------------------------------- 6
def test_fingerprints_follow_the_next_document(spark, make, odd):
    rng = random.Random(4)
    rows = [(i * 3, words(rng, rng.randrange(400))) for i in range(120)]
    got = {r.doc_id: r for r in op6_fingerprints.fingerprints(make(rows, 5)).collect()}
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        n = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[:len(t) - n] + nxt[:n]).encode()).hexdigest()
        assert got[i].n_chars == len(t)
        if len(t) > 500:
            assert got[i].near_edited > 0.25 and got[i].near_next < 0.2
    assert op6_fingerprints.fingerprints(odd).count() == 9
    assert op6_fingerprints.fingerprints(empty(spark)).count() == 0
    same = op6_fingerprints.fingerprints(make([(1, "ab c"), (2, "ab c")])).collect()
    assert [r.near_next for r in same] == [1.0, 1.0] and len({r.fingerprint for r in same}) == 1
    nulls = op6_fingerprints.fingerprints(make([(None, "x"), (None, "y")])).collect()
    assert len(nulls) == 2


def test_common_subsequence():
    rng = random.Random(6)
    for _ in range(50):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 30))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        assert op6_fingerprints.common_subsequence(a, b) == row[-1]


# ---------------------------------------------------------------- 7
@pytest.mark.parametrize("chunk", [4_000, 7])
def test_embeddings_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 24))
    rows = []
    for i in range(120):
        v = centres[i % 6] + rng.standard_normal(24) * 0.28
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(200 + i, rows[0][1], 0) for i in range(3)]
    rows += [(300, None, 0), (301, [0.0] * 24, 0), (302, rows[0][1], None), (303, [float("nan")] + [1.0] * 23, 0),
             (304, [1.0, None] + [1.0] * 22, 0), (305, [1.0, 2.0], 0), (306, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in
           op7_embeddings.near_vectors(df, chunk=chunk).collect()}
    good = [r for r in rows if r[0] < 300]
    links = collections.defaultdict(set)
    for x, y in itertools.combinations(good, 2):
        if x[2] == y[2]:
            a, b = np.array(x[1], np.float32).astype(float), np.array(y[1], np.float32).astype(float)
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[x[0]].add(y[0])
                links[y[0]].add(x[0])
    assert sum(map(len, links.values())) > 50
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i] == (len(links[i]), min(seen), i == min(seen))
    assert op7_embeddings.near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# ---------------------------------------------------------------- 8
def test_line_dedup(spark, make, odd):
    a = [f"line {i}" for i in range(8)]
    rows = [(1, "\n".join(a)), (2, "\n".join(["x", *a[2:6], "y"])), (3, "\n".join(a)), (4, "p\nq"), (5, "\n\n\n\n"),
            (6, "\n\n\n\n"), (7, None)]
    got = {r.doc_id: (r.text, r._n_lines, r._n_removed) for r in op8_lines.dedup_lines(make(rows)).collect()}
    assert got == {1: ("\n".join(a), 8, 0), 2: ("x\ny", 6, 4), 3: ("", 8, 8), 4: ("p\nq", 2, 0),
                   5: ("\n\n\n\n", 5, 0), 6: ("\n\n\n\n", 5, 0), 7: (None, 0, 0)}
    assert op8_lines.dedup_lines(odd).count() == 9 and op8_lines.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_tells_windows_of_equal_xxhash64(spark, make):
    # Two texts of 16 bytes with the same 64-bit hash: the second word undoes the difference of the first.
    m, p1, p2, p4, p5 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5

    def turn(x, r):
        return ((x << r) | (x >> (64 - r))) & m

    def mixed(word):
        return turn(int.from_bytes(word, "little") * p2 & m, 31) * p1 & m

    def state(word):
        return (turn((42 + p5 + 16 & m) ^ mixed(word), 27) * p1 + p4) & m

    one, tail = b"ab\ncd\nef", b"12345678"
    for i in range(1_000_000):
        other = f"x\n{i:05x}\n"[:8].encode().ljust(8, b"z")
        back = state(one) ^ state(other) ^ mixed(tail)
        end = (turn(back * pow(p1, -1, 1 << 64) & m, 33) * pow(p2, -1, 1 << 64) & m).to_bytes(8, "little")
        if other.count(b"\n") == 2 and all(32 <= b < 127 for b in end):
            break
    texts = [(one + tail).decode(), (other + end).decode()]
    assert len({r[0] for r in make(list(enumerate(texts))).select(F.xxhash64("text")).collect()}) == 1
    got = op8_lines.dedup_lines(make(list(enumerate(texts)))).collect()
    assert sorted((r.doc_id, r.text, r._n_removed) for r in got) == [(0, texts[0], 0), (1, texts[1], 0)]


def test_line_dedup_by_row(make):
    a, b = "a1\na2\na3", "b1\nb2\nb3"
    rows = [(1, a), (1, "x\ny\nz\nown"), (1, "p\n" + a), (None, "n\n" + a), (None, b), (None, "m\n" + b), (0, "q\n" + a),
            (4, a), (4, "c1\nc2\nc3")]
    got = sorted(((r.doc_id, r.text, r._n_removed) for r in op8_lines.dedup_lines(make(rows)).collect()), key=str)
    # Of the two b the row with the less text hash has the first place.
    texts = sorted([b, "m\n" + b], key=lambda t: hashlib.md5(t.encode()).digest())
    of_b = [(None, texts[0], 0), (None, "m" if texts[1][0] == "m" else "", 3)]
    want = [(0, "q\n" + a, 0), (1, "", 3), (1, "x\ny\nz\nown", 0), (1, "p", 3), (None, "n", 3), (4, "", 3),
            (4, "c1\nc2\nc3", 0), *of_b]
    assert got == sorted(want, key=str)


def test_line_dedup_stays_off_the_rdd_interface(make, monkeypatch):
    docs = make([(1, "a\nb\nc"), (2, "a\nb\nc")])
    monkeypatch.setattr(type(docs), "rdd", property(lambda self: pytest.fail("rdd")))
    assert sorted(r._n_removed for r in op8_lines.dedup_lines(docs).collect()) == [0, 3]


# ---------------------------------------------------------------- 9
@pytest.mark.parametrize("limits", [{}, {"SMALL": 2, "FEW": 1, "BLOCKED": 10, "CHUNK": 4}])
def test_near_documents_equal_brute_force(spark, make, odd, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(op9_minhash, k, v)
    rng = random.Random(8)
    rows = []
    for g in range(6):
        base = words(rng, 120).split(" ")
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    shared = words(rng, 14)
    rows += [(len(rows) + i, shared + " " + words(rng, rng.randrange(4, 9))) for i in range(40)]
    rows += [(900, rows[0][1].upper()), (901, "one two"), (902, "One  two"), (903, "one"), (904, None), (905, " ")]
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x, y in itertools.combinations(sets, 2):
        if sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
            a, b = sorted((root(x), root(y)))
            parent[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op9_minhash.near_documents(make(rows)).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i, _ in rows}
    if not limits:
        assert op9_minhash.near_documents(odd).count() == 9
        assert op9_minhash.near_documents(empty(spark)).count() == 0


def test_near_documents_that_share_one_key_only(make, monkeypatch):
    # All sets are given one common key and no other, in a bucket above every limit; sizes differ.
    for k, v in {"SMALL": 2, "FEW": 1, "BLOCKED": 10, "CHUNK": 4}.items():
        monkeypatch.setattr(op9_minhash, k, v)
    sketch = op9_minhash.sketch
    monkeypatch.setattr(op9_minhash, "sketch", lambda docs: sketch(docs).withColumn(
        "keys", F.expr("if(n > 0, array(1L), null)")))
    rng = random.Random(9)
    bases = [words(rng, n).split(" ") for n in (60, 60, 80, 100, 300, 400, 55, 74)]
    rows = [(10 * g + i, " ".join(base + [f"end{i}"] * (i > 0))) for g, base in enumerate(bases) for i in range(4)]
    got = {r.doc_id: r.component_id for r in op9_minhash.near_documents(make(rows)).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


def test_size_steps_part_no_pair():
    steps = np.array(op9_minhash.size_steps(10_000))
    n = np.arange(1, 10_000)
    at = np.searchsorted(steps, n, "right")
    largest = np.searchsorted(steps, n * 100 // op9_minhash.PERCENT, "right")
    assert (largest - at <= 1).all()


def test_register_estimate():
    rng = np.random.default_rng(2)
    make_registers = op9_minhash.Registers()
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 1 << 63, 1_000, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        a, b = np.unique(pool[:800]), np.unique(pool[200:])
        errors.append(op9_minhash.estimate((make_registers(a) == make_registers(b)).sum()) - 0.6)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


# ---------------------------------------------------------------- 10
def test_token_files_round_trip(spark, odd, tmp_path):
    files = op10_binary.write_tokens(odd.where("doc_id is null or doc_id <> 4"), f"file:{tmp_path}/t", TOKENIZER)
    got = op10_binary.read_tokens(spark, files).collect()
    rows = sorted(((r.doc_id, r.text) for r in odd.collect() if r.doc_id != 4),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for doc, text in rows:
        ids = ids_of(text, 0)
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    one = op10_binary.read_documents(spark, [f[0] for f in files], [6]).collect()
    assert [(r.doc_id, r.ids) for r in one] == [(6, ids_of("é😀 " * 300, 0).tolist())]
    path = files[-1][0].removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    data[6] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        list(op10_binary.FrameReader(path))
    assert op10_binary.write_tokens(empty(spark), f"file:{tmp_path}/e", TOKENIZER) == []
    assert op10_binary.token_files(spark, empty(spark), TOKENIZER).count() == 0


def test_token_files_with_one_shuffle_partition(spark, make, tmp_path):
    docs = make([(i, f"text {i}") for i in range(40)], 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        files = op10_binary.write_tokens(docs, f"file:{tmp_path}/one", TOKENIZER)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = op10_binary.read_tokens(spark, files).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == list(range(40))


def test_clashing_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "s", 1, 2), (2, "a\nb\nc", "s", 3, 4)],
                               "doc_id long, text string, source string, size long, covered long")
    assert op8_lines.dedup_lines(df).select("size", "covered").count() == 2
    assert op3_mix.mix(df).count() == 2 and op9_minhash.near_documents(df.withColumn("n", F.lit(1))).count() == 2


def test_op9_pairs_of_keys_in_proportion(spark):
    """Keys held by 2 to 14 classes give no more pairs than they have members."""
    from precedent.llm import op9_minhash

    members = spark.createDataFrame([(k, 100 * k + i, 50) for k in range(2, 15) for i in range(k)], "key long, cid long, n long")
    buckets = members.groupBy("key").count().withColumnRenamed("count", "held")
    pairs = op9_minhash._small_pairs(members, buckets).groupBy(F.floor(F.col("a") / 100).alias("key")).count()
    assert pairs.join(buckets, "key").where("count > held").count() == 0
