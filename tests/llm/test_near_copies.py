import corpus_pipeline as cp
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidemark.llm import near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(rows):
    """For each row the smallest index reachable over pairs of similar texts."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.fixture(scope="module")
def edited():
    """300 texts, and a copy of each with single words replaced, so that similarities are spread from 0.7 to 1."""
    random = np.random.default_rng(11)
    rows = [(k, " ".join(f"w{x}" for x in random.integers(0, 5000, 200))) for k in range(300)]
    for k, text in rows[:300]:
        words = text.split()
        for at in random.choice(200, 1 + k % 6, replace=False):
            words[at] = f"new{at}"
        rows.append((1000 + k, " ".join(words)))
    return rows


def test_edited_copies_go(spark, frame, edited):
    docs = frame(edited, "doc_id long, text string")
    kept = {r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()}
    sets = {k: shingles(t) for k, t in edited}
    close = [k for k in range(300) if jaccard(sets[k], sets[1000 + k]) >= 0.8]
    assert 150 < len(close) < 300
    recall = sum(1000 + k not in kept for k in close) / len(close)
    assert recall >= 0.99  # the buckets bring 0.9994 of pairs at 0.8 together, and more above
    assert all(k in kept for k in range(300)) and all(1000 + k in kept for k in range(300) if k not in close)


@pytest.mark.parametrize("chunk", [near_copies.CHUNK, 3])
def test_equals_plain_version(frame, texts, edited, chunk):
    rows = [*texts, *((5000 + k, t) for k, t in edited[:20] + edited[300:320])]
    chain = edited[5][1].split()
    rows += [(6000 + k, " ".join([*chain[: 180 - 8 * k], *(f"x{j}" for j in range(8 * k)), *chain[180:]])) for k in range(8)]
    out = [(r.doc_id, r.text) for r in near_copies.keep_one(frame(rows, "doc_id long, text string"), chunk=chunk).collect()]
    root = groups(rows)
    want = {}
    for (doc_id, _), r in zip(rows, root, strict=True):
        want.setdefault(r, set()).add(doc_id)
    least = sorted(min((k for k in ids if k is not None), default=-1) for ids in want.values())
    assert sorted(-1 if k is None else k for k, _ in out) == least and set(out) <= set(rows)


def sketched(spark, frame, rows):
    """(fp, size, bucket) and (fp, label, code) of texts, as the operator makes them."""
    df = frame(rows, "doc_id long, text string")
    schema = "doc_id long, fp long, size long, code binary, buckets array<long>"
    made = df.mapInArrow(near_copies._sketches(near_copies.SHINGLE, near_copies.SEED, near_copies.BANDS, near_copies.WIDTH), schema)
    made = made.cache()
    return made.select("fp", "size", F.explode("buckets").alias("bucket")), made.select("fp", F.col("fp").alias("label"), "code")


def test_common_boilerplate_ships_no_texts(spark, frame):
    """Texts that share 60 words and are nowhere near 0.8: however many there are, none falls into a unit."""
    random = np.random.default_rng(2)
    common = [f"legal{k}" for k in range(60)]
    rows = [(k, " ".join([*common, *(f"w{x}" for x in random.integers(0, 9000, random.integers(60, 200)))])) for k in range(3000)]
    for many in (1000, 3000):
        keyed, codes = sketched(spark, frame, rows[:many])
        units = near_copies.first_round(keyed, near_copies.CHUNK).join(codes, "fp")
        assert units.count() < 3 * many  # of twelve buckets each
        assert near_copies._grouped(units, near_copies.RADIUS).count() <= many // 500
    assert near_copies.keep_one(frame(rows[:1000], "doc_id long, text string")).count() == 1000


def test_one_large_group_travels_once_per_bucket(spark, frame):
    """Chunks of a large group of copies: the second round has nothing to do when they are one component."""
    random = np.random.default_rng(8)
    base = [f"w{x}" for x in random.integers(0, 9000, 200)]
    rows = []
    for k in range(400):
        words = list(base)
        words[random.integers(200)] = f"new{k}"
        rows.append((k, " ".join(words)))
    keyed, codes = sketched(spark, frame, rows)
    assert near_copies.first_round(keyed, 50).count() <= 400 * near_copies.BANDS
    one = keyed.withColumn("label", F.lit(1).cast("long"))
    assert near_copies.second_round(one, 50).count() == 0
    odd = keyed.withColumn("label", F.when(F.pmod("fp", F.lit(100)) == 0, F.col("fp")).otherwise(F.lit(1).cast("long")))
    rest = odd.filter("label <> 1").select("fp").distinct().count()
    assert near_copies.second_round(odd, 50).count() <= near_copies.BANDS * (400 + 9 * rest)
    assert [r.doc_id for r in near_copies.keep_one(frame(rows, "doc_id long, text string"), chunk=50).collect()] == [0]


def test_kernel_equals_plain_distances():
    random = np.random.default_rng(6)
    base = random.integers(0, 1 << 63, (4, 40), dtype=np.uint64)
    codes = np.repeat(base, 6, axis=1)
    for k in range(codes.shape[1]):
        for bit in random.choice(256, random.integers(0, 40), replace=False):
            codes[bit // 64, k] ^= np.uint64(1) << np.uint64(bit % 64)
    unit = np.sort(random.integers(0, 9, codes.shape[1]))
    label = random.integers(0, 30, codes.shape[1])
    root, paired = near_copies.neighbours(codes, unit, label, 56)
    distance = np.bitwise_count(codes[:, :, None] ^ codes[:, None, :]).sum(axis=0)
    pair = (distance <= 56) & (unit[:, None] == unit) & (label[:, None] != label)
    assert (paired == pair.any(axis=1)).all() and pair.any() and not pair.all(axis=1).any()
    want = np.arange(len(unit))
    while True:
        least = np.minimum(want, np.where(pair, want, len(want)).min(axis=1))
        if (least == want).all():
            break
        want = least
    assert (root == want).all()


def test_fingerprints_are_as_far_apart_as_stated():
    random = np.random.default_rng(1)
    far = []
    for _ in range(60):
        own = random.integers(0, 1 << 63, 360, dtype=np.uint64)
        a, b = near_copies.wide_fingerprint(own[:324]), near_copies.wide_fingerprint(own[36:])  # Jaccard 0.8
        far.append(int(np.bitwise_count(a ^ b).sum()))
    assert abs(np.mean(far) - 38.8) < 3 and max(far) <= near_copies.RADIUS


def test_small_table_and_columns(spark, crowded, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert near_copies.keep_one(docs).count() == len(set(groups(rows)))
    assert near_copies.keep_one(crowded).columns == crowded.columns
    assert near_copies.keep_one(nothing).count() == 0
