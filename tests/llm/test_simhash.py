import os
import random
import re

import xxhash

from foralia.llm import graph, simhash

from .conftest import corpus, union_find


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_matches_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    prints = [slow_fingerprint(r[1]) for r in rows]
    nodes = range(len(rows))
    root = union_find([(i, j) for i in nodes for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4], nodes)
    want = []
    for i in nodes:
        ids = [rows[j][0] for j in nodes if root[j] == root[i] and rows[j][0] is not None]
        signed = prints[i] - (1 << 64) if prints[i] >> 63 else prints[i]
        want.append((rows[i][0], signed, min(ids) if ids else None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_links_are_exact(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(6):
            for _ in range(rng.randint(1, 7)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for most in (1, 3, 4):
        got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), most).collect()}
        mask = (1 << 64) - 1
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= most}
        assert got == want


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 230)] + [(3, 3)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == union_find([e for e in edges if e[0] != e[1]], nodes)


def test_empty(none):
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.keep_one(none).collect() == []


def test_wide_groups_join_similar_texts_and_leave_others(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(4000)]
    bases = [rng.choices(vocabulary, k=300) for _ in range(40)]
    rows, near = [], 0
    for k, base in enumerate(bases):
        copy = list(base)
        for at in rng.sample(range(300), 5):
            copy[at] = "edited"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy).upper())]
    out = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = sum(out[2 * k + 1] == 2 * k for k in range(40))
    assert near >= 38
    assert all(out[2 * k] == 2 * k for k in range(40))


def test_keep_one_handles_edges(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(0) == 3 and set(ids) <= {r[0] for r in rows}
    assert len(corpus()) > len(ids)


def exact_groups(rows):
    """Components over all pairs of similar texts."""
    return union_find([(i, j) for i in range(len(rows)) for j in range(i) if simhash.similar(rows[i][1], rows[j][1], 5, 0.8)], range(len(rows)))


def found_groups(spark, rows):
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_recall_at_the_similarity_and_nothing_under_it(spark):
    """Every base has a copy at 0.8 or a little more, one at 0.85 and one under 0.8: the shingles decide, not the signatures."""
    rng = random.Random(13)
    vocabulary = [f"v{k}" for k in range(5000)]
    rows, want = [], {}
    for k in range(100):
        base = rng.choices(vocabulary, k=400)
        for part, edits in {0: 0, 1: 8, 2: 10, 3: 6}.items():
            copy = list(base)
            for at in range(edits):
                copy[20 + 35 * at + 7 * part] = f"edit{k}{part}{at}"
            rows.append((4 * k + part, " ".join(copy)))
        shingles = lambda text: {tuple(text.split()[i : i + 5]) for i in range(396)}
        a, b, c, d = (shingles(text) for _, text in rows[-4:])
        assert 0.85 > len(a & b) / len(a | b) >= 0.8 > len(a & c) / len(a | c) and len(a & d) / len(a | d) >= 0.85
        assert all(len(x & y) / len(x | y) < 0.8 for x, y in ((b, c), (b, d), (c, d)))
        want |= {4 * k + part: 4 * k for part in (0, 1, 3)} | {4 * k + 2: 4 * k + 2}
    out = found_groups(spark, rows)
    assert all(out[d] == want[d] for d in want if d % 4 in (0, 2))
    assert sum(out[d] == want[d] for d in want if d % 4 == 1) >= 92
    assert sum(out[d] == want[d] for d in want if d % 4 == 3) >= 99


def test_short_texts_are_exact(spark):
    """Texts of one to a hundred words with a word more or less: all pairs at 0.8, whatever their signatures say."""
    rng = random.Random(19)
    texts = []
    for k in range(60):
        base = [f"s{rng.randrange(900)}" for _ in range(rng.choice([1, 4, 5, 8, 9, 13, 30, 66, 84]))]
        texts += [base, [*base, f"more{k}"], base[1:], [*base[:-1], f"last{k}"], [f"first{k}", *base, f"end{k}"]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts) if t]
    rows = [(k, text) for k, (_, text) in enumerate(rows)]
    want = exact_groups(rows)
    assert sum(want[k] != k for k in want) > 60
    assert found_groups(spark, rows) == want


def test_long_texts_need_no_more_memory():
    import numpy as np

    hashes = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 3 * simhash.CHUNK + 7).astype(np.uint64))
    whole = simhash._planes(hashes)
    bits = 2 * np.unpackbits(whole, axis=1).sum(axis=0, dtype=np.int64) > len(hashes)
    assert (simhash.wide_signature(hashes).astype(">i8").view(np.uint8) == np.packbits(bits)).all()


def test_similar_is_exact():
    assert simhash.similar("a b c d e f g h", "A b c d e f g h", 5, 0.8)
    assert simhash.similar(" ".join(map(str, range(8))), " ".join(map(str, range(9))), 5, 0.8)
    assert not simhash.similar(" ".join(map(str, range(7))), " ".join(map(str, range(9))), 5, 0.8)
    assert not simhash.similar("", "", 5, 0.8)


def test_every_member_of_a_family_meets_the_other_groups(spark):
    """Variants of one text, and chains of edits that start at a variant: each similar pair that meets is linked."""
    rng = random.Random(17)
    base = [f"v{rng.randrange(5000)}" for _ in range(400)]

    def edited(text, k, edits=8):
        copy = list(text)
        for at in rng.sample(range(5, 395, 5), edits):
            copy[at] = f"e{k}x{at}"
        return copy

    family = [edited(base, k) for k in range(60)]
    texts = [base, *family]
    for k, member in enumerate(family):
        for j in range(2):
            member = edited(member, f"{k}c{j}")
            texts.append(member)
    rng.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    want, out = exact_groups(rows), found_groups(spark, rows)
    assert sum(out[k] != want[k] for k in want) <= 0.03 * len(rows)


def test_large_ids_and_nulls_survive(spark):
    big = 2**53 + 1
    rows = [(big, "one text of five words"), (None, "another text of five words"), (big + 2, "one text of five words")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in out) == [(str(big), str(big)), (str(big + 2), str(big)), ("None", "None")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == [str(big), "None"]


def test_similar_groups_leave_no_tables_but_their_result(spark, docs):
    from foralia.runtime import scratch_dir

    root = scratch_dir(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    assert simhash.similar_groups(docs).count()
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(root)) - before}
    assert "grouped" in left and not left & {"signatures", "classes", "named", "shared", "near", "crowded", "verified", "components"}


def executions_of(spark, run):
    """The plans of the executions that run() starts, as the session's status store has them when it is done."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda: (found.apply(k) for found in [store.executionsList()] for k in range(found.size()))
    before = max((x.executionId() for x in listed()), default=-1)  # the store forgets old executions, so their count stops growing
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return [x.physicalPlanDescription() for x in sorted(listed(), key=lambda x: x.executionId()) if x.executionId() > before]


def test_components_run_one_execution_a_round_and_broadcast_nothing(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(7, k) for k in range(200, 230)], "a long, b long")
    plans = executions_of(spark, lambda: graph.components(edges).count())
    assert len(plans) > 2 and all("InsertIntoHadoopFsRelationCommand" in p for p in plans[:-1])
    assert not any("BroadcastExchange" in p for p in plans)


def test_components_of_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert graph.components(spark.createDataFrame([(5, 5)], "a long, b long")).collect() == []


def test_near_dedup_broadcasts_no_narrow_table(spark, docs):
    plans = executions_of(spark, lambda: simhash.similar_groups(docs).count())
    written = {m[1]: p for p in plans if (m := re.search(r"Arguments: file:\S*/(crowded|mixed|grouped|edges)-", p))}
    assert set(written) == {"crowded", "mixed", "grouped", "edges"}
    assert not [k for k, p in written.items() if "BroadcastExchange" in p]
