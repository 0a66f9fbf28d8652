"""Decontamination, near-duplicates, line dedup, quality rules, repeated strings: against brute force."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from freshet.llm import common, components, decontaminate, line_dedup, quality, simhash, suffix_dedup
from freshet.llm.components import connected
from freshet.llm.common import scratch

from . import brute

EXTRA = brute.SCHEMA + ", term string, h1 long, pos int, spans string, fp string, line string, quality double"


@pytest.fixture(scope="module")
def rows():
    return brute.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return brute.frame(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def wide(spark, rows):
    """The same documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "t", 1, 2, "s", "f", "l", 0.5) for r in rows], EXTRA)


def items_of(rows):
    long = [r for r in rows if r[1] and len(brute.words(r[1])) > 30]
    return [(1, " ".join(brute.words(long[0][1])[5:30])), (2, long[1][1]), (3, "the"), (3, long[2][1][:60]), (4, None), (5, "  "), (10, " ".join(brute.words(long[0][1])[5:30])), (11, "nowhere at all to be found here " * 3)]


@pytest.mark.parametrize("size", [1, 3, 10])
def test_decontamination(spark, rows, docs, size):
    items = items_of(rows)
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), size).collect()
    assert {r.doc_id: (r.n_hit, r.item_ids) for r in found if r.n_hit} == brute.decontaminated(rows, items, size)
    near = brute.near_items(rows, items, size)
    assert {r.doc_id: r.near_ids for r in found} == near and (size != 3 or sum(map(len, near.values())) > sum(len(r.item_ids) for r in found))


def test_decontamination_shuffled_and_with_other_columns(spark, rows, wide, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    wide = wide.withColumns({c: F.lit(1) for c in ("mark", "_hit", "_doc", "_mark", "_row", "start", "window")})
    items = items_of(rows)
    hit = brute.decontaminated(rows, items)
    kept = decontaminate.decontaminate(wide, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == wide.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - set(hit)


def test_decontamination_edges(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).count() == 0 and decontaminate.decontaminate(docs, none).count() == docs.count()
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    twice = brute.frame(spark, [(None, "x y z", None, None, None), (1, "x y z", None, None, None), (1, "x y z", None, None, None)])
    got = decontaminate.contamination(twice, spark.createDataFrame([(7, "y Z")], "item_id long, text string")).collect()
    assert sorted([(r.doc_id or 0, r.n_hit) for r in got]) == [(0, 2), (1, 2)]
    # a phrase lies in one text, not across two that share a doc_id
    apart = brute.frame(spark, [(1, "a b c d e f g h i nine", None, None, None), (1, "x x x x x x x x x j", None, None, None), (1, "a b c d e f g h i j", None, None, None)])
    kept = decontaminate.decontaminate(apart, spark.createDataFrame([(7, "a b c d e f g h i j")], "item_id long, text string")).collect()
    assert sorted(r.text[-1] for r in kept) == ["e", "j"] and len(kept) == 2


def test_decontamination_is_linear_in_a_long_text(spark):
    text = "the " * 20_000 + "a b c " * 7000
    items = spark.createDataFrame([(1, "the"), (2, "a b c " * 50), (3, "the the the")], "item_id long, text string")
    begin = time.time()
    got = decontaminate.contamination(brute.frame(spark, [(1, text, None, None, None)]), items).first()
    assert got.n_hit == 41_000 and got.item_ids == ["1", "2", "3"] and time.time() - begin < 60


def test_proximity(spark, docs, rows):
    terms = spark.createDataFrame([("the",), ("of",)], "term string")
    index = decontaminate.write_postings(decontaminate.marked(docs), terms, scratch(spark, "t"))
    pairs = spark.createDataFrame([(1, "the", "of")], "query_id int, term_a string, term_b string")
    got = {(r.doc_id, r.pos_a, r.pos_b) for r in decontaminate.proximity_matches(index, pairs, 3).collect()}
    expected = {(d, i, j) for d, t, *_ in rows for w in [brute.words(t)] for i, a in enumerate(w) if a == "the" for j in range(max(0, i - 3), min(len(w), i + 4)) if w[j] == "of"}
    assert got == expected and got


@pytest.mark.parametrize(("distance", "width", "bucket"), [(4, 4, 4096), (3, 5, 1), (4, 4, 1), (2, 5, 4096), (0, 5, 4096)])
def test_near_duplicates(docs, rows, distance, width, bucket):
    prints, groups = brute.near(rows, distance, width)
    got = simhash.near_duplicates(docs, distance, width, bucket_pairs=bucket).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == groups


def groups_of(component):
    held = {}
    for node, name in component.items():
        held.setdefault(name, set()).add(node)
    return {frozenset(g) for g in held.values()}


@pytest.mark.parametrize(("distance", "bucket"), [(4, 4096), (4, 2), (3, 1)])
def test_links_keep_all_components(spark, distance, bucket):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40)
    prints = {int(s) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for s in seeds for _ in range(8)}
    nodes = spark.createDataFrame([(p, p) for p in prints], "fp long, component long")
    n, both = simhash.bit_counts(nodes)
    assert n == len(prints) and both[0, 0] == sum(p & 1 for p in prints)
    found = simhash.fingerprint_components(nodes.select("fp"), distance, bucket)
    expected = brute.components(prints, lambda a, b: (a ^ b).bit_count() <= distance)
    assert groups_of({r.fp: r.component for r in found.collect()}) == groups_of(expected)


@given(st.integers(1, 10**6), st.integers(0, 6), st.integers(0, 99))
@settings(max_examples=30, deadline=None)
def test_plans_satisfy_the_pigeonhole(n, distance, seed):
    bits = np.random.default_rng(seed).random((200, 64)) < np.random.default_rng(seed).random(64)
    plan = simhash.choose_plan(n, (bits.T.astype(int) @ bits.astype(int)) * n // 200, distance)
    assert sum(plan.thresholds) == distance - len(plan.parts) + 1 and sorted(b for p in plan.parts for b in p) == list(range(64))


def test_one_of_each_keeps_columns_of_any_name(spark, rows):
    names = ["_gone", "_again", "_nth", "node", "component", "_row", "key"]
    wide = brute.frame(spark, rows).withColumns({c: F.lit(c) for c in names})
    kept = simhash.one_of_each(wide).collect()
    assert all(r[c] == c for r in kept for c in names) and {r.doc_id for r in kept} == set(brute.alike_groups(rows).values())


def test_one_of_each(spark, rows):
    given_ = [*rows, rows[0], (None, rows[0][1], None, None, None), (500, "b " * 9, "x", None, None), (500, "a " * 9, "x", None, None)]
    kept = simhash.one_of_each(brute.frame(spark, given_)).collect()
    ids = [r.doc_id for r in kept]
    assert len(ids) == len(set(ids)) and None not in ids and 0 in ids and 500 in ids
    copies = {r[1] for r in rows if r[1] and len(r[1].split()) > 9}
    assert all(sum(r.text == t for r in kept) <= 1 for t in copies) and set(kept[0].asDict()) == set(brute.frame(spark, []).columns)
    assert simhash.one_of_each(brute.frame(spark, [])).count() == 0


@pytest.mark.parametrize("few", [16, 1])
def test_one_of_each_links_from_similarity_on(spark, monkeypatch, few):
    rng = np.random.default_rng(8)
    rows = []
    for base in range(30):
        own = [f"w{k}" for k in rng.integers(0, 5000, rng.integers(30, 160))]
        passage = [f"p{k}" for k in range(20)]
        for copy in range(6):
            text = list(own)
            for spot in rng.choice(len(text), rng.integers(0, 6), replace=False):
                text[spot] = f"x{base}y{copy}z{spot}"
            rows.append((len(rows), " ".join(text + passage * (base % 2)), None, None, None))
    sets = {r[0]: {tuple(w[k : k + 5]) for w in [r[1].split()] for k in range(len(w) - 4)} for r in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    expected = brute.components(sets, alike)
    monkeypatch.setattr(simhash, "CENTRES", 2)
    monkeypatch.setattr(simhash, "CENTRE_ROUNDS", 2)
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(brute.frame(spark, rows).repartition(3), few=few).collect()}
    assert got == expected == brute.alike_groups(rows) and 40 < len(set(expected.values())) < 170
    if few == 16:
        assert {r.doc_id for r in simhash.one_of_each(brute.frame(spark, rows)).collect()} == set(expected.values())


def test_keys_of_sets_move_at_any_size(docs, monkeypatch):
    plans = []
    settle = simhash.settled
    monkeypatch.setattr(simhash, "settled", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settle(df))
    simhash.similar_texts(docs)
    members = next(p for p in plans if "posexplode(keys" in p)
    assert "Window" in members and "Join" not in members
    compared = [p for p in plans if "array_intersect" in p]
    assert compared and all(p.count("strategy=broadcast") <= 1 for p in compared)  # the pairs, not the sets


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1050), 1000)}


def test_components_by_joins(spark, monkeypatch):
    monkeypatch.setattr(components, "DRIVER_EDGES", 0)
    test_components_of_chains_and_hubs(spark)


def test_components_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_EDGES", 5)
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))]
    reached = brute.components({n for e in edges for n in e}, lambda a, b, near=set(edges): (a, b) in near or (b, a) in near)
    few = components.stars(spark.createDataFrame(edges, "a long, b long").repartition(3))
    assert few.count() < 3 * 400 and {r.node: r.component for r in connected(few).collect()} == {n: c for n, c in reached.items() if (n, n) not in edges or list(reached.values()).count(c) > 1}


def jobs_of(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_few_jobs_for_groups_of_near_copies(spark):
    # what a job leaves on the driver (classes, threads, plans, task data) adds up
    rng = np.random.default_rng(6)
    seeds = [int(s) for s in rng.integers(0, 1 << 62, 60)]
    prints = {s ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 5), replace=False)) for s in seeds for _ in range(8)}
    nodes = common.settled(spark.createDataFrame([(p,) for p in prints], "fp long"))
    expected = groups_of(brute.components(prints, lambda a, b: (a ^ b).bit_count() <= 4))
    for bucket, most in ((4096, 25), (2, 80)):
        got, jobs = jobs_of(spark, f"near-{bucket}", lambda bucket=bucket: simhash.fingerprint_components(nodes, 4, bucket).collect())
        assert groups_of({r.fp: r.component for r in got}) == expected and jobs <= most


def test_crowded_fingerprints_keep_all_components(spark):
    # 3000 fingerprints with the same bits in all partitions but one, crowded in every one
    rng = np.random.default_rng(7)
    prints = sorted({int(x) for x in rng.integers(0, 1 << 16, 3000)})
    nodes = common.settled(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = simhash.fingerprint_components(nodes, 2, 64).collect()
    held = np.array(prints)
    apart = np.bitwise_count(held[:, None] ^ held[None, :]) <= 2
    a, b = np.nonzero(apart)
    names, least = components.contracted(held[a], held[b])
    assert groups_of({r.fp: r.component for r in got}) == groups_of(dict(zip(names.tolist(), least.tolist(), strict=True)))


@pytest.mark.parametrize("edits", [0, 1])
def test_line_dedup(docs, rows, edits):
    found = {r.doc_id: set(r.removed) for r in line_dedup.repeated_lines(docs, edits=edits).collect()}
    assert found == dict(brute.removed_lines(rows, edits=edits)) and found


def test_line_dedup_finds_every_edit(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    base = "Überall the same líne of text 12"
    edited = [base[:i] + base[i + 1 :] for i in range(len(base))] + [base[:i] + "#" + base[i:] for i in range(len(base) + 1)] + [base[:i] + "#" + base[i + 1 :] for i in range(len(base))]
    other = ["Überall THE SAME líne of text 99", base[:-2] + "##", base + "??"]
    texts = [base, *edited, *other, "x\n  " + base + "\t\nshort\nshort", None, ""]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    expected = brute.removed_lines(rows)
    got = {r.doc_id: set(r.removed) for r in line_dedup.repeated_lines(brute.frame(spark, rows)).collect()}
    assert got == dict(expected) and {r[0] for r in rows[1 : len(edited) + 1]} <= set(got)


def test_line_dedup_keeps_rows_and_columns(spark, wide, rows):
    gone = brute.removed_lines(rows)
    wide = wide.withColumn("lines", F.lit(3)).withColumn("removed", F.lit("r"))
    cut = line_dedup.dedup_lines(wide)
    assert cut.columns == wide.columns
    got = {r.doc_id: r.text for r in cut.collect()}
    assert got == {d: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t, *_ in rows}
    assert line_dedup.dedup_lines(wide.limit(0)).count() == 0
    nulls = brute.frame(spark, [(None, "a line that is long enough", None, None, None), (1, "a line that is long enough", None, None, None)])
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(nulls).collect()} == {None: "a line that is long enough", 1: ""}


def test_line_dedup_of_rows_that_share_a_doc_id(spark):
    p, q, r = ("line number %s is long enough to count" % (x * 9) for x in "pqr")
    for ids in ((7, 7), (None, None)):
        rows = [(ids[0], f"{p}\n{q}", None, None, None), (ids[1], f"{r}\n{p}", None, None, None)]
        got = sorted(x.text for x in line_dedup.dedup_lines(brute.frame(spark, rows)).collect())
        assert sorted("\n".join(got).split("\n")) == sorted([p, q, r])
    twice = [(1, p, None, None, None)] * 2 + [(2, f"{p}\n{q}", None, None, None)]
    assert sorted(x.text for x in line_dedup.dedup_lines(brute.frame(spark, twice)).collect()) == sorted([p, p, q])


def test_keep_good_stores_no_texts(spark, tmp_path):
    import random
    from pathlib import Path

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(quality.COMMON_WORDS["en"]) if k % 3 else f"{rng.getrandbits(60):x}" for k in range(900)), "en", "s", 0) for i in range(40)]
    rows += [(50, "too short", "en", "s", 0), (51, None, "en", "s", 0), (52, "", None, "s", 0), (53, rows[0][1], None, "s", 0), (54, rows[0][1], "en", "s", 0)]
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    stored = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = stored()
    kept = quality.keep_good(brute.frame(spark, rows).repartition(3))
    assert stored() - before < sum(len(r[1] or "") for r in rows) / 8
    judged = quality.judge(brute.frame(spark, rows)).filter("quality.kept").select("_row.*").collect()
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, judged)) and {0, 54} <= {r.doc_id for r in judged} and not {50, 51, 52} & {r.doc_id for r in judged}


def test_coarse_counts_lose_no_pair(spark):
    import random

    rng = random.Random(8)
    sets = [{rng.getrandbits(32) for _ in range(n)} for n in (1, 2, 9, 300, 300, 1000, 3000, 90_000)]
    for s in sets[:7]:
        for share in (0.02, 0.1, 0.11, 0.12, 0.3):  # on either side of the bound, by both shingles lost and shingles changed
            gone = set(rng.sample(sorted(s), round(share * len(s))))
            sets += [s - gone | {rng.getrandbits(32)}, s - gone | {rng.getrandbits(32) for _ in gone}]
    sets = [np.array(sorted(s), np.uint32).view(np.int32).tolist() for s in sets]
    frame = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "node long, size int, shingles array<int>").repartition(3)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a)]
    coarse = common.settled(simhash.coarse_counts(frame))
    got = {tuple(r) for r in simhash.may_be_alike(common.settled(spark.createDataFrame(pairs, "a long, b long")), coarse, 0.8).collect()}
    alike = {(a, b) for a, b in pairs if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    assert alike <= got and len(alike) > 20
    assert not {(4, 3), (5, 3), (6, 5)} & got  # no shingle in common


def test_quality_counts(docs, rows, spark, wide):
    junk = [(900, "a b c d e f g " * 40, "en", None, 0), (901, "x y z w v x y z w v x", "en", None, 0), (902, "q\nq\n\n \nr\nq" + " z" * 4, "en", None, 0)]
    every = rows + junk
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for judged in (quality.judge(brute.frame(spark, every)), quality.judge_once(brute.frame(spark, every))):
        got = {r._row.doc_id: tuple(r.quality[c] for c in columns) for r in judged.collect()}
        assert got == {d: brute.base_counts(t) for d, t, *_ in every}
        assert all(not (r.quality.base_failed and r.quality.kept) for r in judged.collect())
    clashing = quality.keep_good(wide.withColumn("_text", F.lit("x")).withColumn("_words", F.lit(1)))
    assert clashing.columns == [*wide.columns, "_text", "_words"] and {r.quality for r in clashing.collect()} <= {0.5}


def test_quality_verdicts(spark):
    import random

    rng = random.Random(5)
    frequent = quality.COMMON_WORDS["en"]
    prose = [" ".join(rng.choice(frequent) if rng.random() < 0.4 else rng.choice(["river", "stone", "walking", "green", "lamp"]) + rng.choice(["", "s", "ed"]) for _ in range(300)) for _ in range(40)]
    marks = " ".join(f"{rng.choice(['river', 'stone'])}{rng.randint(0, 99)}{rng.choice(['###', '%%%', '$$$'])}" for _ in range(300))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(prose)] + [(100, marks, "en", "s", 0), (101, None, "en", "s", 0), (102, marks, None, "s", 0)]
    judged = {r._row.doc_id: r.quality for r in quality.judge(brute.frame(spark, rows)).collect()}
    assert not judged[100].kept and not judged[102].kept and not judged[101].kept
    assert all(judged[i].char_distance < 0.3 for i in range(40)) and sum(judged[i].kept or judged[i].base_failed for i in range(40)) == 40
    assert quality.keep_good(brute.frame(spark, rows)).columns == brute.frame(spark, rows).columns
    assert quality.keep_good(brute.frame(spark, [])).count() == 0
    assert quality.judge(brute.frame(spark, rows).drop("lang")).first().quality.word_distance is None
    foreign = [*rows, (200, "mal bir iki bal kar dost yol gece " * 4 + " ".join(f"kelime{c}" for c in "abcdefghijklmnopqrstuvwxyz") * 3, "tr", "s", 0)]
    judged = {r._row.doc_id: r.quality for r in quality.judge(brute.frame(spark, foreign)).collect()}
    assert judged[200].word_distance is None and judged[0].word_distance is not None


def test_jensen_shannon(spark):
    counts, reference = [3, 0, 5, 2], [0.1, 0.4, 0.5, 0.0]
    p, q = np.array(counts) / 10, np.array(reference)
    m = (p + q) / 2
    divergence = sum(0.5 * x * np.log2(x / z) for v in (p, q) for x, z in zip(v, m, strict=True) if x)
    got = spark.range(1).select(quality.jensen_shannon(F.array(*[F.lit(c).cast("long") for c in counts]), F.lit(10), reference)).first()[0]
    assert abs(got - np.sqrt(divergence)) < 1e-12


def test_exchanges_of_settled_tables_are_deleted(spark):
    known = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    common.freed(spark)
    time.sleep(0.5)
    before, made = known.size(), common.settled(spark.range(50).repartition(3, "id"))
    assert known.size() > before
    common.freed(spark)
    time.sleep(0.5)
    assert known.size() <= before and made.count() == 50


def test_exchanges_are_deleted_at_once(spark):
    known = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    common.freed(spark)
    time.sleep(0.5)
    before, base = known.size(), spark.range(50).repartition(3, "id")
    made = common.settled_alone(base.groupBy((base.id % 3).alias("k")).count())
    assert known.size() <= before and made.count() == 3


def test_repeats_move_texts_at_any_size(docs):
    # a small corpus takes the joins of a large one, so that disk grows as the input does
    plan = suffix_dedup.remove_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("collection", [1, 16_384])
def test_repeated_strings_in_documents(docs, rows, collection):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, collection=collection).collect()}
    expected = brute.without_repeats(rows)
    assert got == expected and sum(v[1] for v in expected.values()) > 500


def test_repeated_strings_shuffled_in_files_and_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(suffix_dedup, "LEAST_BUCKETS", 2)
    tricky = rows + [(200, "ab" * 400, None, None, None), (201, "ab" * 300 + "c", None, None, None), (202, "z" * 49, None, None, None), (203, "z" * 50, None, None, None), (204, "y" + "z" * 60, None, None, None), (-5, "z" * 51, None, None, None)]
    frame = brute.frame(spark, tricky).withColumn("mark", F.lit("m")).withColumn("spans", F.lit(1))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame, memory=0).collect()}
    assert got == brute.without_repeats(tricky)


def test_repeated_strings_by_a_neighbourhood_whose_high_bits_are_zero(spark):
    data = np.random.default_rng(3).integers(97, 123, 4_000_000, dtype=np.uint8)
    powers = suffix_dedup._powers(data, 5)
    gram = suffix_dedup._mix(powers[4])
    inner = np.arange(60, len(gram) - 60)
    zero = inner[suffix_dedup._at(powers, inner - 17, 33) >> np.uint64(48) == 0]
    # strings of 50 bytes with the anchor in their second half, so that only its left neighbourhood lies in them
    begins = [p - off for p in zero.tolist() for off in range(18, 35) if int(np.argmin(gram[p - off : p - off + 35])) == off][:1]
    shared = data[begins[0] : begins[0] + 50].tobytes().decode()
    rows = [(1, "0" * 40 + shared + "1" * 40, None, None, None), (2, "2" * 40 + shared + "3" * 40, None, None, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(brute.frame(spark, rows)).collect()}
    assert got == brute.without_repeats(rows) and got[2][1] == 50


def test_repeated_strings_edges(spark):
    text = "0123456789" * 6
    same = brute.frame(spark, [(3, text, None, None, None), (3, text, None, None, None), (None, text, None, None, None), (4, None, None, None, None)])
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in suffix_dedup.remove_repeats(same).collect())
    assert got == [(-1, 0), (3, 60), (3, 60), (4, 0)]
    assert suffix_dedup.remove_repeats(brute.frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(same, length=20)


def test_long_documents_are_cut_into_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 300)
    rng = np.random.default_rng(0)
    text = rng.integers(97, 123, 2000, dtype=np.uint8).tobytes()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "mark": pa.array([5, 6], pa.int64()), "text": pa.array([text, text[700:1500]], pa.binary())})
    rows = [r for b in suffix_dedup._anchor_rows(iter([batch]), 50, 1) for r in b.to_pylist()]
    out = [r for b in suffix_dedup._settle_bucket(0, 1, rows, 50) for r in b.to_pylist()]
    spans = suffix_dedup._merge([r["spans"] for r in out if r["spans"] and r["doc_id"] == 2], 50)
    assert spans[0] <= 40 and spans[-1] >= 760


@given(st.lists(st.text("ab", max_size=12), min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_collection_transform(texts):
    data = [t.encode() for t in texts]
    columns = suffix_dedup.Columns(None)
    suffix_dedup.collection_transform(data, columns)
    suffixes = sorted((t[k:], i, len(t) - k) for i, t in enumerate(data) for k in range(len(t) + 1))
    # end marks are smaller than all bytes, and ordered by their text
    suffixes.sort(key=lambda s: ([c + 1 for c in s[0]] + [0], s[1]))
    assert columns.read("of").tolist() == [s[1] for s in suffixes] and columns.read("size").tolist() == [s[2] for s in suffixes]
    assert columns.read("bwt").tolist() == [data[i][len(data[i]) - n - 1] + 1 if n < len(data[i]) else 0 for _, i, n in suffixes]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert columns.read("lcp").tolist() == [0] + [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False)]
