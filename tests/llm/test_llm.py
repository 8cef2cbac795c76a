"""Operators of the llm subpackage against brute force, SQL and edge cases."""

import base64
import datetime as dt
import itertools
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wellspring.llm import canonical, golden, matching, mixing, subjects, tokenizing

VOCABULARY = tokenizing.VOCABULARY
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the vocabulary files")


# -- survivors

def test_best_bundles_against_brute_force():
    rnd = random.Random(5)
    for _ in range(200):
        bundles = {b: [((rnd.randrange(6), i), {k: rnd.choice("xyz") for k in rnd.sample(["u", "v"], rnd.randrange(3))}) for i in range(rnd.randrange(5))] for b in "abc"}

        def value(choice):
            said = {}
            out = []
            for b, i in zip("abc", choice):
                if i is None:
                    out.append((0, ()))
                    continue
                t, says = bundles[b][i]
                if any(said.get(k, v) != v for k, v in says.items()):
                    return None
                said |= says
                out.append((1, t))
            return tuple(out)

        best = max(v for c in itertools.product(*[[None, *range(len(bundles[b]))] for b in "abc"]) if (v := value(c)) is not None)
        got = golden.best_bundles(bundles)
        assert value([got.get(b) for b in "abc"]) == best


def _sources(spark):
    day = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(1, "Well Head", "ready", day), (2, "LAS 2.0", "ready", day), (3, None, "ready", day), (4, "well_head", "failed", day), (5, "wellheads", "ready", None)]
    return spark.createDataFrame(rows, "id long, data_type string, status string, imported_at timestamp")


def _trust(spark):
    return spark.createDataFrame([("well_head", 1), ("las", 4), ("other", 7)], "data_type string, trust_rank int")


MENTION = "id long, well_id long, source_id long, raw_name string, uwi string, x double, y double, crs string, kb_elevation double, total_depth double, rank string, status string"


def _mentions(spark):
    nan = float("nan")
    rows = [
        (1, 7, 2, "A", "37-00000-0001-00", 1.0, 2.0, "c", 100.0, 3000.0, "clash", None),
        (2, 7, 1, "A", "37-00000-0001-00", 1.0, 2.0, "c", -999.25, 3010.0, None, None),
        (3, 7, 4, "A", None, None, None, None, 101.0, 3005.0, None, None),  # failed import
        (4, 7, 5, "A", None, nan, 2.0, None, 1000.0, None, None, None),  # far from the middle
        (5, 7, 3, "A", None, None, None, None, 102.0, nan, None, None),  # no type
        (5, 7, 3, "A", None, None, None, None, 102.0, nan, None, None),
        (6, 8, 1, "B", None, None, None, None, 50.0, 50.0, None, None),  # a single mention
        (7, None, 1, "C", None, None, None, None, 50.0, 50.0, None, None),
        (8, 9, 1, "D", None, None, None, None, 0.0, None, None, None),
        (9, 9, 99, "D", None, None, None, None, 60.0, None, None, None),  # unknown import
    ]
    return spark.createDataFrame(rows, MENTION)


def test_well_survivors(spark):
    m = _mentions(spark)
    got = {tuple(r) for r in golden.well_survivors(m, _sources(spark), _trust(spark)).collect()}
    assert got == {(7, "kb_elevation", 1), (7, "total_depth", 2), (7, "preferred_source_id", 2)}
    assert golden.well_survivors(m.limit(0), _sources(spark), _trust(spark)).count() == 0
    wide = golden.golden_wells(m, _sources(spark), _trust(spark)).collect()
    assert [(r["well_id"], r["kb_elevation"], r["total_depth"], r["x"], r["preferred_source_id"]) for r in wide] == [(7, 100.0, 3010.0, 1.0, 1)]


def test_preferred_source_depends_on_the_chosen(spark):
    # source 1 is the most trusted, but only a far-off value comes from it; the preferred one is of the chosen
    rows = [(i, 7, src, "A", None, None, None, None, kb, td, None, None) for i, src, kb, td in ((1, 2, 100.0, None), (2, 3, 100.5, 3000.0), (3, 2, 101.0, None), (4, 1, 900.0, None), (5, 3, None, 3001.0))]
    got = {tuple(r) for r in golden.well_survivors(spark.createDataFrame(rows, MENTION), _sources(spark), _trust(spark)).collect()}
    assert got == {(7, "kb_elevation", 3), (7, "total_depth", 5), (7, "preferred_source_id", 3)}
    # a search that may not have its best preferred source takes the next one that fits
    kb, td = [((-1, 0, 5), {"kb_import": "2"})], [((-2, 0, 6), {"td_import": "3"})]
    preferred = [((0, 0, 9), {"kb_import": "9"}), ((-2, 0, 6), {"td_import": "3"}), ((-1, 0, 5), {"kb_import": "2"})]
    assert golden.best_bundles({"kb": kb, "td": td, "preferred": preferred}) == {"kb": 0, "td": 0, "preferred": 2}


def test_source_types(spark):
    df = spark.createDataFrame([(t,) for t in ("WELLHEAD", "井头", "DEV", "devn. survey", ".las", "well log (LAS)", "rock core", "Interp", "prod. history", "misc", " ", None)], "t string")
    got = [r[0] for r in df.select(golden.source_type(F.col("t"))).collect()]
    assert got == ["well_head", "well_head", "deviation", "deviation", "las", "las", "core", "interpretation", "production", "other", None, None]


# -- matching

@pytest.mark.parametrize(
    "name, want",
    [
        ("GAS-198", ("GAS", 198, 0)), ("ＧＡＳ－１９８", ("GAS", 198, 0)), ("042/CCU", ("CCU", 42, 0)), ("Well EBT-125", ("EBT", 125, 0)), ("ISLOMBEL NO. 32", ("ISLOMBEL", 32, 0)), ("MCC-092 S/T 2", ("MCC", 92, 2)),
        ("UCL-104侧1", ("UCL", 104, 1)), ("Well MCC-25-ST02", ("MCC", 25, 2)), ("GAS-0S2 (P)", ("GAS", 52, 0)), ("CCU-I37", ("CCU", 137, 0)), ("GAS_0280 [inj]", ("GAS", 280, 0)), ("OBB98", ("OBB", 98, 0)), ("wbk-12 sidetrack 1", ("WBK", 12, 1)),
        ("164/GASST1", ("GAS", 164, 1)), ("UCL-lll", ("UCL", 111, 0)), ("MCC #61", ("MCC", 61, 0)), ("", (None, None, 0)), (None, (None, None, 0)), ("x" * 5000, ("X" * 5000, None, 0)),
    ],
)
def test_names(name, want):
    assert matching.parse_name(name) == want


RECORD = "id long, name string, uwi string, x double, y double, e_letters string"


def _wells(spark):
    rows = [(i, f"ABC-{i:03d}", f"37-00001-{i:04d}-00", 400000.0 + 700 * i, 4000000.0 + 500 * (i % 7), "clash") for i in range(1, 60)]
    rows += [(100, "ABC-005ST1", "37-00001-0005-01", 403500.0, 4002500.0, None), (101, None, None, None, None, None)]
    return spark.createDataFrame(rows, RECORD)


@pytest.mark.parametrize("copies", [1, 400])
def test_matches(spark, copies):
    nan = float("nan")
    rows = [
        (1, "ABC_0007", None, None, nan, None), (2, "ACB-008", "37000010008", None, None, None), (3, None, None, 406300.0, 4001000.0, None), (4, "ABC 999", None, None, None, None), (5, "ABC-005 S/T 1", None, None, None, None),
        (6, "ABC-006 ST2", None, None, None, None), (7, "abc 10", None, 4001500.0, 407000.0, None), (8, "ABC-011", "37-00001-0012-00", 407.7, 4002.0, None), (9, None, None, None, None, None),
    ]
    rows += [(1000 + i, "ABC-020", None, None, None, None) for i in range(copies)]  # a hot entity
    out = {r["mention_id"]: r["entity_id"] for r in matching.match(spark.createDataFrame(rows, RECORD), _wells(spark), spark.createDataFrame([], "name string, entity_id long")).collect()}
    assert {k: v for k, v in out.items() if k < 1000} == {1: 7, 2: 8, 5: 100, 7: 10, 8: 11}
    assert [out[1000 + i] for i in range(copies)] == [20] * copies


def test_number_slip_needs_identifier_and_place(spark):
    rows = [(1, "ABC-017", "37-00001-0010-00", 407000.0, 4001500.0, None), (2, "ABC-999", "37-00001-0010-00", None, None, None), (3, "ABC-997", None, 407000.0, 4001500.0, None), (4, "BCA-021", None, None, None, None), (5, "ABD-022", None, None, None, None)]
    out = {r["mention_id"]: (r["entity_id"], r["confidence"]) for r in matching.match(spark.createDataFrame(rows, RECORD), _wells(spark), spark.createDataFrame([], "name string, entity_id long")).collect()}
    assert {k: v[0] for k, v in out.items()} == {1: 10, 4: 21} and all(0.5 <= v[1] <= 1 for v in out.values())


def test_one_description_of_a_source_has_an_entity(spark):
    rows = [("a", 1, "ABC-017", "37-00001-0010-00", 407000.0, 4001500.0), ("a", 2, "ABC-010", None, None, None), ("a", 3, "ABC_010", None, None, None), ("b", 4, "ABC 10", None, None, None), (None, 5, "ABC 10", None, None, None)]
    df = spark.createDataFrame(rows, "scope string, id long, name string, uwi string, x double, y double")
    out = {r["mention_id"]: r["entity_id"] for r in matching.match(df, _wells(spark), spark.createDataFrame([], "name string, entity_id long")).collect()}
    assert out == {1: 10, 4: 10, 5: 10}


def _greatest_total(matrix):
    n, m = len(matrix), len(matrix[0])
    plans = (p for p in itertools.product(range(-1, m), repeat=n) if len({x for x in p if x >= 0}) == sum(x >= 0 for x in p))
    return max(sum(matrix[i][x] for i, x in enumerate(p) if x >= 0) for p in plans if all(x < 0 or matrix[i][x] is not None for i, x in enumerate(p)))


def test_assignment_against_brute_force(spark):
    rnd = random.Random(3)
    rows, want = [], 0.0
    for scope in range(12):
        n, m = rnd.randrange(1, 5), rnd.randrange(1, 5)
        matrix = [[rnd.randrange(50, 101) / 100 if rnd.random() < 0.6 else None for _ in range(m)] for _ in range(n)]
        got = matching.best_assignment(np.array([[float("nan") if c is None else c for c in r] for r in matrix]))
        assert len({c for c in got if c >= 0}) == sum(c >= 0 for c in got)
        total = _greatest_total(matrix)
        assert sum(matrix[i][c] for i, c in enumerate(got) if c >= 0) == pytest.approx(total)
        want += total
        rows += [(scope * 100 + i, str(scope), 7 + j, matrix[i][j]) for i in range(n) for j in range(m) if matrix[i][j] is not None]
    pairs = spark.createDataFrame(rows, "part long, scope string, entity_id long, confidence double")
    worth = {(r[0], r[2]): r[3] for r in rows}
    for dense, slack in ((matching.DENSE, 1e-9), (0, matching.STEP * len({r[0] for r in rows}))):
        out = matching.assign(pairs, dense).collect()
        assert len({r["part"] for r in out}) == len(out) == len({(r["part"] // 100, r["entity_id"]) for r in out})
        assert want - slack <= sum(worth[r["part"], r["entity_id"]] for r in out) <= want + 1e-9


def test_matches_of_empty_tables(spark):
    none = spark.createDataFrame([], RECORD)
    known = spark.createDataFrame([], "name string, entity_id long")
    assert matching.match(none, _wells(spark), known).count() == 0
    assert matching.match(_wells(spark), none, known).count() == 0


def test_window_reaches_over_partitions(spark):
    rows = [(f"1|{i:05d}", 0.0, i % 3 == 0, i) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, sub double, entity boolean, id long")
    got = {tuple(r) for r in matching.neighbours(df, 7).collect()}
    ents = [i for i in range(300) if i % 3 == 0]
    want = set()
    for m in (i for i in range(300) if i % 3):
        k = sum(e < m for e in ents)
        want |= {(m, e) for e in ents[max(0, k - matching.WINDOW) : k + matching.WINDOW]}
    assert got == want


# -- canonical lists

CURVES = [("GR", "Gamma ray"), ("RHOB", "Bulk density"), ("DRHO", "Density correction"), ("RT", "Deep resistivity"), ("WOB", "Weight on bit"), ("BS", "Bit size"), ("PEF", "Photoelectric factor")]


@pytest.mark.parametrize(
    "mnemonic, text, want",
    [
        ("gr", None, "GR"), ("ＧＲ", "", "GR"), ("G.R", None, "GR"), ("GR_LWD", None, "GR"), ("GR(API)", None, "GR"), ("ILD.R3", None, "RT"), ("Gmama Ray", None, "GR"), ("Gamm aRay", None, "GR"), ("Bulk density correcton", None, "DRHO"), ("Formation bulk density", None, "RHOB"),
        ("Weight O Bit", None, "WOB"), ("C15", "Gamma ray run 2", "GR"), ("曲线3", "自然伽马", "GR"), ("MAGX", "magnetometer x axis", "UNMATCHED"), ("UNKNOWN", "see header", "UNMATCHED"), (None, None, "UNMATCHED"), ("", "", "UNMATCHED"), ("Z" * 9000, None, "UNMATCHED"),
    ],
)
def test_curves(mnemonic, text, want):
    assert canonical.resolve_curve(canonical.curve_list(CURVES), mnemonic, text) == want


HORIZONS = [("UPPERVELMORASANDSTONE", "Upper Velmora Sandstone"), ("LOWERVELMORASANDSTONE", "Lower Velmora Sandstone"), ("QUARRINSHALE", "Quarrin Shale"), ("QUARRINSANDSTONE", "Quarrin Sandstone")]


@pytest.mark.parametrize(
    "name, want",
    [
        ("top of Velmora.Sst.Upr_v2", "UPPERVELMORASANDSTONE"), ("T_下_VELMORA_砂岩 REV2", "LOWERVELMORASANDSTONE"), ("QUUARRIN.SH 顶面", "QUARRINSHALE"), ("Quarrin Ss (depth)", "QUARRINSANDSTONE"), ("Quarrin", "UNMATCHED"), ("Velmora Sandstone", "UNMATCHED"), ("Brastow Marl", "UNMATCHED"), (None, "UNMATCHED"), ("  ", "UNMATCHED"),
    ],
)
def test_horizons(name, want):
    assert canonical.resolve_horizon(canonical.horizon_list(HORIZONS), name) == want


def test_entries(spark):
    c = spark.createDataFrame([(1, "GR", None, "x"), (2, "gr", None, "x"), (2, "gr", None, "x"), (3, None, "Gamma ray", None)], "id long, mnemonic string, description string, canonical_key string")
    ref = spark.createDataFrame(CURVES, "curve_key string, curve_name string")
    assert sorted(tuple(r) for r in canonical.curve_entries(c, ref).collect()) == [(2, "GR"), (2, "GR"), (3, "GR")]
    assert canonical.curve_entries(c.limit(0), ref).count() == 0
    h = spark.createDataFrame([(1, "Quarrin Sh", None), (2, "Quarrin Sh", "QUARRINSHALE")], "alias_id long, alias_name string, canonical_key string")
    groups = spark.createDataFrame(HORIZONS, "canonical_key string, canonical_name string")
    assert [tuple(r) for r in canonical.horizon_entries(h, groups).collect()] == [(1, "QUARRINSHALE")]
    # names that only the table itself spells, and aliases given as a table
    h = spark.createDataFrame([(1, "Old K7 reef", None), (2, "OLD-K7 REEF", "QUARRINSHALE"), (3, "both", "QUARRINSHALE"), (4, "both", "QUARRINSANDSTONE"), (5, "Both", None), (6, None, None)], h.schema)
    assert sorted(tuple(r) for r in canonical.horizon_entries(h, groups).collect()) == [(1, "QUARRINSHALE"), (5, "UNMATCHED"), (6, "UNMATCHED")]
    c = spark.createDataFrame([(1, "GR", "natural count rate"), (2, "QQ7", "Natural count rate."), (3, "zzgam", None), (4, "ild", None)], "id long, mnemonic string, description string")
    assert sorted(tuple(r) for r in canonical.curve_entries(c, ref).collect()) == [(2, "GR"), (3, "UNMATCHED"), (4, "RT")]
    aliases = spark.createDataFrame([("zzgam", "GR"), ("zzgam", "no such entry"), (None, "GR")], "alias string, entry string")
    assert sorted(tuple(r) for r in canonical.curve_entries(c, ref, aliases).collect()) == [(2, "GR"), (3, "GR"), (4, "UNMATCHED")]


# -- tokenizing

@needs_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_reference_encoder(text):
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = test_ids_equal_the_reference_encoder.__dict__.setdefault("e", tiktoken.Encoding("own", pat_str=tokenizing.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    assert tokenizing.encode([text])[0] == e.encode_ordinary(text)


@needs_vocabulary
def test_token_ids(spark):
    rows = [(1, "Mud weight was raised to 1.04.", "x"), (2, "", "x"), (3, None, "x"), (4, "  \n", "x"), (5, "ab" * 50_000, None), (1, "Mud weight was raised to 1.04.", "x")]
    out = tokenizing.token_ids(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    got = {r["doc_id"]: r["ids"] for r in out}
    assert len(out) == 6 and got[2] == [] and got[3] is None and len(got[4]) > 0
    e = tokenizing.encoder(VOCABULARY)
    for d, t, _ in rows:
        if t:
            assert b"".join(e.bytes_of[i] for i in got[d]).decode() == t


@needs_vocabulary
def test_a_full_trie_begins_afresh(monkeypatch):
    texts = ["alpha beta gamma", "delta epsilon", "alpha zeta"]
    want = tokenizing.encode(texts)
    monkeypatch.setattr(tokenizing, "MAX_NODES", 3)
    e = tokenizing.encoder(VOCABULARY)
    e.words.clear()
    assert [tokenizing.encode([t])[0] for t in texts] == want


# -- mixing

def test_plan_meets_targets_within_caps():
    sizes = [("a", 0.5, 1, 1000), ("b", 0.3, 4, 50), ("c", 0.2, 2, 0)]
    free = {r.source: r for r in mixing.plan(sizes)}
    assert free["b"].rate == 4.0 and isinstance(free["b"].rate, float) and free["a"].rate * 1000 / (free["b"].rate * 50) == pytest.approx(5 / 3) and free["c"].rate == 0
    fixed = {r.source: r for r in mixing.plan(sizes, total=1000)}
    assert fixed["b"].rate == 4.0 and fixed["a"].rate * 1000 == pytest.approx(800)
    assert mixing.plan([("a", 0.5, 1, 0)])[0].rate == 0.0


def test_pivot_keeps_tokens_and_chances():
    for p, a, q, b in ((0.3, 5, 0.6, 9), (0.9, 1, 0.9, 100), (0.2, 7, 0.2, 7)):
        outcomes = [mixing.pivot(p, a, q, b, c) for c in (0.0, 0.999999)]
        up, down = min(1 - p, q * b / a), min(p, (1 - q) * b / a)
        w = down / (up + down)
        for x, y in outcomes:
            assert a * x + b * y == pytest.approx(a * p + b * q) and (x in (0, 1) or y in (0, 1)) and 0 <= min(x, y) <= max(x, y) <= 1
        assert w * outcomes[0][0] + (1 - w) * outcomes[1][0] == pytest.approx(p)


@needs_vocabulary
def test_mix(spark):
    rows = [(i, "word " * (5 + i % 40), "big", "c") for i in range(900)] + [(2000 + i, "term " * 30, "small", None) for i in range(10)] + [(3000, None, "small", None), (3001, "", "small", None), (3002, "x", None, None), (3003, "x", "untargeted", None), (0, "word " * 5, "big", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string").repartition(7)
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mix(docs, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert got["small"]["most_copies"] == 3 and got["big"]["most_copies"] == 1 and got["none"]["reached_share"] == 0
    assert got["big"]["mixed_tokens"] == pytest.approx(2 * got["small"]["mixed_tokens"], abs=60)
    assert {r["source"] for r in mixed.select("source").distinct().collect()} == {"big", "small"}
    assert sorted(map(tuple, mixing.mix(docs, targets)[0].collect())) == sorted(map(tuple, mixed.collect()))
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0
    assert mixing.mix(docs, targets.limit(0))[0].count() == 0


# -- subjects

def test_sentences_leave_out_what_is_no_running_text():
    text = "From: data office\n~Curve Information\n GR.API   : run 1\n12 3.4 5\n<p>Mud weight was raised to 1.2 and losses slowed.</p>\n- Also, the caliper shows a rugose hole. Regards, data office.\nGAS-079 | 2017/11\n第48页。泥浆密度提高到1.2,漏失停止。"
    assert subjects.sentences(text) == ["mud weight was raised to 1.2 and losses slowed.", "also, the caliper shows a rugose hole.", "泥浆密度提高到1.2,漏失停止。"]


def test_document_subjects(spark):
    rows = [
        (1, "Mud weight was raised to 1.04 and losses slowed. The string became stuck while reaming. The referee sent off a defender before half time.", "x"),
        (2, "", None), (3, None, None), (4, "   ", None), (5, "La presiÃ³n de cabeza cayÃ³ y el pozo dejÃ³ de fluir.", None), (6, "含水饱和度由电阻率计算,胶结指数2。", None), (7, "aaaa " * 20_000, None), (8, "Thc c1ay drapes and thc bulk dcnsity. The wavclet is zero phase after deconvolution.", None),
        (1, "Mud weight was raised to 1.04 and losses slowed.", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, subject_code string")
    labels = spark.createDataFrame([(1, "drilling"), (1, "drilling"), (None, "law"), (99, "law")], "doc_id long, subject_code string")
    got = {(r["doc_id"], r["subject_code"]) for r in subjects.document_subjects(df, labels).collect()}
    assert {(1, "drilling"), (1, "sport"), (5, "production"), (6, "petrophysics"), (8, "geophysics")} <= got and not {d for d, _ in got} & {2, 3, 4, 7}
    areas = spark.createDataFrame([("production", "p"), ("drilling", "d")], "subject_code string, description string")
    assert [tuple(r) for r in subjects.unlabelled_subjects(df, labels, areas).collect()] == [(5, "production")]
    assert subjects.document_subjects(df.limit(0), labels).count() == 0
    assert subjects.document_subjects(df, labels.limit(0)).count() >= 5


def test_terms_are_weighed_and_learned_from_labels(spark):
    texts = [("The zorbel was wound tightly and the plim held again. A referee spoke.", "safety"), ("Seals of the zorbel gave way in the night. The referee was ill.", "safety")] * 4 + [("The orchard bloomed early in the south.", "law"), ("Nobody came to the meeting in the south.", "law")] * 4
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(texts)], "doc_id long, subject_code string")
    got = {(t, s): w for t, s, w in subjects.learned_terms(docs, labels)}
    assert got["zorbel", "safety"] > 2 and got["orchard", "law"] > 1 and ("the", "safety") not in got and ("the", "law") not in got
    assert ("referee*", "sport") not in got and got["goalkeeper*", "sport"] == 1.0  # the labels speak against one, and do not show the other
    one = subjects.calibration(spark.createDataFrame([(0, "safety", 0.2), (1, "safety", 0.4), (8, "safety", 0.16)], "doc_id long, subject_code string, share double"), labels.where("doc_id in (0, 1, 8)"))
    assert subjects.best_thresholds(one) == {"safety": 0.2, "law": 0.25}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the given tables")
def test_labelled_sample_is_met(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/subject_labels.parquet")
    # half of the labels teach, the other half judges
    known, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").select("doc_id", "subject_code").distinct()
    got = subjects.document_subjects(docs, known).distinct().join(held.select("doc_id").distinct(), "doc_id", "left_semi")
    hits = got.join(held, ["doc_id", "subject_code"], "left_semi").count()
    assert hits / held.count() > 0.9 and hits / got.count() > 0.9
