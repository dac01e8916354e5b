import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.functions import text
from plantlens.functions.vocab import TREE_BRANCHES
from plantlens.operators import autofill, cases, matching, nodes, retrieval, similarity
from plantlens import session
from plantlens.sources import store


def incidents(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, machine string, description string, type_incident string, severite string")
    return store.conform(df, "incidents")


def projects(spark, rows):
    return store.conform(spark.createDataFrame(rows, "id bigint, incident_id bigint, titre string, statut string"), "projets_ac")


def test_cold_start_uses_templates(spark):
    new = incidents(spark, [(1, "M1", "Premier defaut", "Defaut produit", None)])
    empty = {t: store.empty(spark, t) for t in ("incidents", "projets_ac", "chemins_pourquoi", "feedback_chemins")}
    tree = cases.generate_trees(new, empty["incidents"], empty["projets_ac"], empty["chemins_pourquoi"], empty["feedback_chemins"])
    rows = tree.collect()
    assert len(rows) == 25 and sum(r.est_cause_racine for r in rows) == 5
    assert all(r.source_cas_id is None and r.origine == "template_synthetique" for r in rows)
    assert 0.30 <= cases.tree_confidence(tree).first().global_confidence <= 0.45


def test_learning_from_a_validated_case(spark):
    history = incidents(spark, [(1, "M3 Soudeuse", "Defauts soudure repetes", "Defaut produit", "haute")])
    first = projects(spark, [(1, 1, "Reduire defauts M3", "valide")])
    no_nodes, no_votes = store.empty(spark, "chemins_pourquoi"), store.empty(spark, "feedback_chemins")
    tree = cases.generate_trees(history, history.limit(0), first.limit(0), no_nodes, no_votes)
    saved = cases.save_trees(no_nodes, tree.withColumn("projet_id", F.lit(1).cast("bigint"))).cache()
    assert saved.count() == 25 and saved.where("parent_id IS NULL").count() == 5
    by_id = {r.id: r for r in saved.collect()}
    for r in by_id.values():
        if r.parent_id is not None:
            parent = by_id[r.parent_id]
            assert parent.niveau == r.niveau - 1 and parent.branche_m == r.branche_m
    votes = spark.createDataFrame(
        [(1, "technician", "valide"), (1, "production", "valide"), (1, "ceo", "abstention")], "projet_id bigint, role_valideur string, decision string"
    )
    outcome = cases.record_outcomes(votes, saved)
    assert outcome.count() == 10 and {r.decision for r in outcome.collect()} == {1}
    feedback = store.append(no_votes, outcome, "feedback_chemins", ["chemin_id", "role_valideur"])
    weights = cases.node_weights(saved, feedback).where("est_cause_racine").collect()
    assert all(r.weight == pytest.approx(1 + 0.3 * math.log(3)) for r in weights)
    node_patches, incident_patches, report = cases.enrich_validated(first, saved, feedback)
    assert report.first().noeuds_enrichis == 25 and incident_patches.first().statut == "clos"
    learned = store.apply_patches(saved, node_patches, "chemins_pourquoi").drop("changed")
    assert learned.agg(F.max("confidence")).first()[0] <= 0.95
    new = incidents(spark, [(2, "M3 Soudeuse", "Soudures faibles intermittentes", "Defaut produit", "haute")])
    found = similarity.find_similar(new, history.unionByName(new), 3, exclude_self=True).first()
    assert found.id == 1 and found.similarity > 0.5
    tree2 = cases.generate_trees(new, history.unionByName(new), first, learned, feedback).collect()
    assert len(tree2) == 25 and all(r.source_cas_id == 1 and r.origine == "cas_historique" for r in tree2)
    saved.unpersist()


def test_saving_replaces_old_nodes(spark):
    old = store.conform(
        spark.createDataFrame([(1, 7, "Milieu", 1, "q", "r"), (2, 8, "Milieu", 1, "q", "r")], "id bigint, projet_id bigint, branche_m string, niveau int, question string, reponse string"),
        "chemins_pourquoi",
    )
    new = incidents(spark, [(5, "M1", "x", "y", "haute")])
    tree = cases.generate_trees(new, new.limit(0), store.empty(spark, "projets_ac"), old.limit(0), store.empty(spark, "feedback_chemins"))
    saved = cases.save_trees(old, tree.withColumn("projet_id", F.lit(7).cast("bigint")))
    assert saved.where("projet_id = 7").count() == 25 and saved.where("projet_id = 8").count() == 1
    assert saved.select("id").distinct().count() == 26


def test_refusal_sends_the_project_back(spark):
    ps = projects(spark, [(1, 1, "a", "validation_en_cours"), (2, 1, "b", "validation_en_cours"), (3, 1, "c", "cadrage")])
    votes = store.conform(
        spark.createDataFrame(
            [(1, 1, "technician", "refuse", "2026-01-01"), (2, 2, "maintenance", "refuse", "2026-01-01"), (3, 2, "technician", "valide", "2026-01-02"),
             (4, 2, "production", "valide", "2026-01-01"), (5, 3, "technician", "refuse", "2026-01-01")],
            "id bigint, projet_id bigint, role_valideur string, decision string, cree_le string",
        ), "validations",
    )
    state = cases.validation_state(ps, votes)
    got = {r.projet_id: (r.nouveau_statut, r.resultat) for r in cases.apply_votes(state).collect()}
    assert got == {1: ("cadre", "refuse_back_to_cadrage"), 2: ("valide", "valide"), 3: ("cadrage", None)}
    assert {(r.projet_id, r.vote_group) for r in cases.pending_votes(ps, votes).collect()} == {(1, "prod"), (3, "prod")}


def test_transitions(spark):
    ps = projects(spark, [(1, 1, "a", "brut"), (2, 1, "b", "cadrage"), (3, 1, "c", "clos")])
    asked = spark.createDataFrame([(1, "fiabilise"), (1, "clos"), (2, "analyse"), (3, "brut"), (9, "brut")], "projet_id bigint, demande string")
    got = {(r.projet_id, r.demande): (r.ok, r.raison) for r in cases.check_transitions(asked, ps).collect()}
    assert got[(1, "fiabilise")] == (True, "") and not got[(1, "clos")][0] and "['fiabilise']" in got[(1, "clos")][1]
    assert not got[(2, "analyse")][0] and got[(3, "brut")][1].endswith("aucun") and "introuvable" in got[(9, "brut")][1]


def test_store_rules(spark):
    rows = spark.createDataFrame(
        [(1, 5, 1), (2, 5, 7), (3, None, 0), (3, 99, -1)], "id bigint, chemin_id bigint, decision int"
    )
    nodes_ = spark.createDataFrame([(5,)], "id bigint")
    conformed = store.conform(rows, "feedback_chemins")
    found = {(r.rule, r.column, r.id) for r in store.constraint_violations({"feedback_chemins": conformed}).collect()}
    assert found == {("check", "decision", 2), ("not_null", "chemin_id", 3), ("unique", "id", 3)}
    orphans = store.constraint_violations({"feedback_chemins": conformed, "chemins_pourquoi": store.conform(nodes_, "chemins_pourquoi")})
    assert ("reference", "chemin_id", 3) in {(r.rule, r.column, r.id) for r in orphans.collect()}
    assert store.accept(conformed, "feedback_chemins").count() == 2


def test_patches_touch_only_listed_columns(spark):
    base = incidents(spark, [(1, "M1", "d", "t", "haute"), (2, "M2", "d", "t", "haute")])
    patches = spark.createDataFrame([(1, "fiabilise", "M9", 1), (1, "clos", "M9", 2)], "id bigint, statut string, machine string, patch_no int")
    got = {r.id: r for r in store.apply_patches(base, patches, "incidents").collect()}
    assert (got[1].statut, got[1].machine, got[1].changed) == ("clos", "M1", True)
    assert (got[2].statut, got[2].changed) == ("brut", False)


def test_model_versions_and_retention(spark):
    v = store.conform(
        spark.createDataFrame([(1, "Machine", True), (2, "Machine", False), (3, "Methode", True)], "id bigint, m_axis string, active boolean"), "model_versions"
    )
    got = {r.id: r.active for r in store.activate_models(v, spark.createDataFrame([(2,)], "id bigint")).collect()}
    assert got == {1: False, 2: True, 3: True}
    both = v.withColumn("active", F.lit(True))
    assert ("unique", "m_axis") in {(r.rule, r.column) for r in store.constraint_violations({"model_versions": both}).collect()}
    a = spark.range(100).select("id", (F.col("id") * 2).alias("x"))
    assert store.data_hash(a).first() == store.data_hash(a.orderBy(F.rand())).first()
    assert store.data_hash(a).first() != store.data_hash(a.where("id < 99")).first()


def test_node_rules(spark):
    rows = [
        (1, "Absence de procédure, pas de plan"), (1, "En été il fait chaud"), (1, "Fuite visible"), (3, "Fuite visible"),
        (5, "Vis desserree"), (2, "L'opérateur a oublié, manque de rigueur"), (1, None),
    ]
    got = nodes.analyze_nodes(spark.createDataFrame(rows, "niveau int, reponse string")).collect()
    assert [r.type for r in got] == ["cause_racine", "condition", "symptome", "cause_directe", "cause_directe", "cause_directe", "cause_directe"]
    assert got[0].confidence == pytest.approx(0.9) and got[0].should_stop and got[0].markers == ["absence de", "pas de plan"]
    assert got[4].should_stop and not got[3].should_stop
    assert got[5].is_blame and not got[5].is_root and not got[5].should_stop and "manque de" in got[5].markers and got[5].relance_question


def test_families(spark):
    rows = [("Température buse",), ("lot humidité et réglage",), ("tempe de visite",), ("",), (None,), ("USURE du moteur",)]
    got = [r.f for r in spark.createDataFrame(rows, "c string").select(text.families_of("c").alias("f")).collect()]
    assert got == [["Machine"], ["Matiere", "Methode"], [], [], [], ["Machine"]]


def test_small_text_helpers(spark):
    df = spark.createDataFrame([(0.5, "x" * 150), (0.9, "court"), (1.2, None)], "c double, t string")
    got = df.select(text.stars("c").alias("s"), text.shorten("t").alias("t")).collect()
    assert [r.s for r in got] == ["★★☆☆☆", "★★★★☆", "★★★★★"]
    assert len(got[0].t) == 140 and got[0].t.endswith("...") and got[1].t == "court"
    pair = spark.createDataFrame([(1, "panne moteur moteur", "moteur casse"), (2, None, "x y z")], "id int, a string, b string")
    got = {r.id: r.similarity for r in similarity.text_similarity(pair, ["id"], "a", "b").collect()}
    assert got[1] == pytest.approx(2 / (math.sqrt(5) * math.sqrt(2))) and got[2] == 0.0
    df = spark.createDataFrame([("M1", "é", "haute", "m1", "É", "faible"), (None, "a", None, None, "b", "haute")], "m string, t string, s string, m2 string, t2 string, s2 string")
    left = {"machine": F.col("m"), "type_incident": F.col("t"), "cree_par_role": F.lit("")}
    right = {"machine": F.col("m2"), "type_incident": F.col("t2"), "cree_par_role": F.lit("")}
    rows = df.select(similarity.categorical_similarity(left, right).alias("c"), similarity.numeric_similarity(F.col("s"), F.col("s2")).alias("n")).collect()
    assert [r.c for r in rows] == pytest.approx([2 / 2.4, 0.0]) and [r.n for r in rows] == pytest.approx([1 / 3, 0.5])


def test_stored_trees_replace_projects_in_their_folders(spark, tmp_path):
    ddl = "id bigint, projet_id bigint, branche_m string, niveau int, question string, reponse string"
    rows = [(i, i % 9 if i % 9 else None, "Milieu", 1, "q", f"r{i}") for i in range(1, 91)]
    old = store.conform(spark.createDataFrame(rows, ddl), "chemins_pourquoi")
    path = str(tmp_path / "nodes")
    store.write_grouped(old, path, "projet_id", 4)
    assert store.read_grouped(spark, path).count() == 90
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "nodes").rglob("*.parquet")}
    fresh = store.conform(spark.createDataFrame([(900, 3, "Milieu", 1, "q", "new")], ddl), "chemins_pourquoi")
    store.replace_groups(spark, path, fresh, "projet_id", spark.createDataFrame([(5,), (77,)], "projet_id bigint"), 4)
    got = {(r.id, r.projet_id, r.reponse) for r in store.read_grouped(spark, path).collect()}
    want = {(i, p, t) for i, p, _, _, _, t in rows if p not in (3, 5)} | {(900, 3, "new")}
    assert got == want
    touched = {r[0] for r in store._bucketed(spark.createDataFrame([(3,), (5,), (77,)], "p bigint"), "p", 4).select("bucket_").collect()}
    for p, stamp in before.items():
        if int(p.parent.name.split("=")[1]) not in touched:
            assert p.stat().st_mtime_ns == stamp
    everything = store.read_grouped(spark, path).select("projet_id").distinct()
    store.replace_groups(spark, path, fresh.limit(0), "projet_id", everything, 4)  # folders may lose all rows
    assert spark.read.schema(fresh.schema).parquet(path).count() == 0


@pytest.mark.parametrize(("least", "tenant"), [(0.2, False), (0.0, False), (0.45, True)])
def test_similarity_equals_pairwise_formula(spark, monkeypatch, least, tenant):
    monkeypatch.setattr(matching, "SALT_ROWS", 10)  # frequent terms are dealt to several tasks
    rng = np.random.default_rng(0)
    words = ["moteur", "fuite", "vis", "lot", "buse", "colle", "bruit"]
    severities = ["faible", "haute", "critique", None]

    def make(n, first):
        return [
            (first + i, f"M{rng.integers(3)}", " ".join(rng.choice(words, rng.integers(0, 9))), str(rng.choice(["a", "É"])), severities[rng.integers(4)])
            for i in range(n)
        ]

    ddl = "id bigint, machine string, description string, type_incident string, severite string"
    q_rows, h_rows = make(23, 0), make(150, 30)
    company = lambda rows: spark.createDataFrame(rows, ddl).withColumn("entreprise_id", F.col("id") % 3)
    h_rows += q_rows[:8]
    got = similarity.find_similar(company(q_rows), company(h_rows).repartition(6), 4, least, exclude_self=True, same_tenant=tenant)
    level = {"faible": 1, "haute": 3, "critique": 4}
    fold = lambda s: s.lower().replace("é", "e")

    def score(a, b):
        ta, tb = [[w for w in f"{r[2]} {fold(r[3])}".split() if len(w) > 1] for r in (a, b)]
        dot = sum(ta.count(w) * tb.count(w) for w in set(ta))
        norm = math.sqrt(sum(ta.count(w) ** 2 for w in set(ta)) * sum(tb.count(w) ** 2 for w in set(tb)))
        cat = (a[1] == b[1]) + (fold(a[3]) == fold(b[3]))
        num = 0.5 if a[4] is None or b[4] is None else 1 - abs(level[a[4]] - level[b[4]]) / 3
        return round(0.5 * (dot / norm if norm else 0) + 0.3 * cat / 2.4 + 0.2 * num, 9)

    want = set()
    for a in q_rows:
        ranked = sorted(((-score(a, b), b[0]) for b in h_rows if b[0] != a[0] and score(a, b) >= least and (not tenant or a[0] % 3 == b[0] % 3)))[:4]
        want |= {(a[0], i + 1, b, -s) for i, (s, b) in enumerate(ranked)}
    assert {(r.case_id, r["rank"], r.id, r.similarity) for r in got.collect()} == want


def test_index_scores_few_rows(spark):
    """Long postings of frequent words are not scored for queries that rare words decide."""
    rng = np.random.default_rng(4)
    common = [f"mot{i}" for i in range(6)]
    rare = lambda i: f"rare{i // 5} piece{i // 5} zone{i // 5} poste{i // 5}"
    rows = [(i, f"M{i // 5}", f"{rng.choice(common)} {rng.choice(common)} {rare(i)}", "panne", "haute") for i in range(600)]
    ddl = "id bigint, machine string, description string, type_incident string, severite string"
    past = spark.createDataFrame(rows, ddl).repartition(4)
    asked = spark.createDataFrame([(1000 + i, f"M{i}", f"mot1 {rare(5 * i)}", "panne", "haute") for i in range(40)], ddl)
    work = similarity.find_similar(asked, past, 3, work=True).collect()
    assert len(work) == 40 and max(r.candidates for r in work) < 30
    found = similarity.find_similar(asked, past, 3).collect()
    assert len(found) == 120 and all(r.id // 5 == r.case_id - 1000 for r in found)


def test_batches_of_queries_store_no_pairs(spark, monkeypatch):
    """Many alike rows: the same result in many batches and parts, with little shuffled and nothing left of it."""
    rng = np.random.default_rng(11)
    words = [f"mot{i}" for i in range(30)]
    rows = [(i, f"M{rng.integers(4)}", " ".join(rng.choice(words, 8)), "panne", "haute", i % 3) for i in range(400)]
    ddl = "id bigint, machine string, description string, type_incident string, severite string, entreprise_id bigint"
    df = spark.createDataFrame(rows, ddl).repartition(4)
    whole = similarity.find_similar(df, df, 3, exclude_self=True, same_tenant=True).collect()
    monkeypatch.setattr(matching, "BATCH_TERMS", 300)
    monkeypatch.setattr(matching, "TASK_PAIRS", 2000)
    before = _shuffled(spark)
    cut = similarity.find_similar(df, df, 3, exclude_self=True, same_tenant=True).collect()
    assert len(whole) == 1200 and sorted(cut) == sorted(whole)
    assert _shuffled(spark) - before < 1 << 20  # 53000 pairs of a company share a word
    twice = df.unionByName(df)  # rows that come twice count once
    assert sorted(similarity.find_similar(twice, twice, 3, exclude_self=True, same_tenant=True).collect()) == sorted(whole)


def test_texts_are_dealt_by_their_size(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_CHARS", 100)
    df = spark.createDataFrame([(i, "mot " * 10, None) for i in range(50)], "id bigint, text string, note string").repartition(1)
    assert session.dealt_by_text(df, ["text", "note"], "id").rdd.getNumPartitions() == 20
    assert retrieval.vocabulary(df, "text").where("term = 'mot'").first().tf == 500


def _shuffled(spark) -> int:
    """Bytes that shuffles have written in this session and that are still there."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for folder in folders for f in Path(folder).rglob("shuffle_*") if f.is_file())


def test_no_history_and_no_text(spark):
    ddl = "id bigint, machine string, description string, type_incident string, severite string"
    asked = spark.createDataFrame([(1, "M1", None, None, None), (2, None, "", "", "x")], ddl)
    assert similarity.find_similar(asked, asked.limit(0), 3).count() == 0
    past = spark.createDataFrame([(5, "M1", None, None, None), (6, "M2", "bruit", "", "haute"), (7, "m1", "", None, None)], ddl)
    got = {(r.case_id, r["rank"], r.id, r.similarity) for r in similarity.find_similar(asked, past, 2).collect()}
    assert got == {(1, 1, 5, 0.225), (1, 2, 7, 0.225), (2, 1, 5, 0.1), (2, 2, 6, 0.1)}


@pytest.mark.parametrize("wanted", [1, 7, 40, 5000, None])
def test_vocabulary_keeps_the_most_frequent_terms(spark, monkeypatch, wanted):
    monkeypatch.setattr(retrieval, "DIGIT_BITS", 2)
    rng = np.random.default_rng(7)
    words = [f"w{i:02d}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40), p=np.arange(1, 61) / 1830))) for i in range(80)]
    tf, df = Counter(), Counter()
    for _, text in rows:
        w = text.split()
        terms = w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        tf.update(terms)
        df.update(set(terms))
    want = sorted(tf, key=lambda t: (-tf[t], t))[:wanted]
    got = retrieval.vocabulary(spark.createDataFrame(rows, "id bigint, text string").repartition(5), "text", wanted).collect()
    assert {(r.term, r.tf, r.df) for r in got} == {(t, tf[t], df[t]) for t in want} and len(got) == len(want)


def test_text_engine(spark):
    rows = [
        (0, "collage", "temperature colle basse", "Machine", "Temperature colle basse"), (1, "collage", "temperature colle trop basse ce matin", "Machine", "Temperature colle basse"),
        (2, "impression", "encre decalee sur papier", "Matiere", "Encre humide"), (3, "impression", "encre pale", "", "Sans branche"),
    ]
    df = spark.createDataFrame([(*r, "2026-01-02T00:00:00") for r in rows], "id bigint, defect_type string, text string, validated_branch string, validated_root_cause string, created_at string")
    engine = retrieval.TextEngine.fit(df)
    asked = spark.createDataFrame([(1, "colle basse temperature"), (2, "encre"), (3, "zzz")], "id bigint, text string")
    got = engine.suggest(asked).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.cause) for r in got] == [(1, "Temperature colle basse"), (2, "Encre humide")]
    assert got[0].branch == "Machine" and 0 < got[0].confidence <= 1 and got[0].explanation.endswith("2026-01-02")
    assert not retrieval.TextEngine.fit(df.limit(2)).is_trained
    whole = retrieval.TextEngine.fit(df, max_features=None).suggest(asked).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.cause, r.confidence) for r in whole] == [(r.query_id, r.cause, r.confidence) for r in got]


def test_rca_round_trip_and_text(spark):
    df = spark.createDataFrame(
        [(1, "pli", "ctx", {"t": 1.5}, {"Machine": ["a", "b"]}, "a", "Machine", "op", ""), (2, "x", None, None, None, None, None, None, "2026")],
        "id bigint, defect_type string, context string, parameters map<string,double>, causes_5m map<string,array<string>>, "
        "validated_root_cause string, validated_branch string, operator string, created_at string",
    )
    back = retrieval.rca_text(store.decode_rca(store.encode_rca(df))).orderBy("id").collect()
    assert back[0].text == "pli | ctx | t=1.5 | Machine: a, b" and back[0].created_at and back[0].parameters == {"t": 1.5}
    assert back[1].text == "x" and back[1].causes_5m == {} and back[1].context == ""


def test_autofill(spark):
    targets = spark.createDataFrame([("t", 10.0, 20.0)], "parameter string, lo double, hi double")
    values = spark.createDataFrame([("t", 5.0), ("t", 25.126), ("t", 15.0), ("u", 99.0)], "parameter string, value double")
    assert {r.suspect for r in autofill.out_of_target(values, targets).collect()} == {"t bas (5.00 < 10.0)", "t haut (25.13 > 20.0)"}
    history = spark.createDataFrame([(float(i), 5.0, 1.0 if i < 3 else None) for i in range(10)], "a double, flat double, few double")
    current = spark.createDataFrame([("a", 40.0), ("flat", 9.0), ("few", 50.0)], "parameter string, value double")
    hits = autofill.atypical_lots(current, history, ["a", "flat", "few"]).collect()
    assert [r.parameter for r in hits] == ["a"] and hits[0].suspect.startswith("Lot atypique sur a (z=")
    files_ = [spark.createDataFrame([(1, 5.0, None)], "t int, a double, b double"), spark.createDataFrame([(9, 7.0, 2.0)], "t int, a double, b double")]
    merged = autofill.merge_contexts([autofill.last_values(f, ["t"]) for f in files_])
    assert {r.parameter: r.value for r in merged.collect()} == {"t": 9.0, "a": 7.0, "b": 2.0}
    assert len(autofill.empty_form(spark).collect()) == 5


def test_framing(spark):
    inc = incidents(spark, [(1, "CMS 2", "x" * 130, "t", "haute"), (2, "M1", "texte", "t", "haute")])
    choices = spark.createDataFrame([(1, "BRA-01 — Joints brases froids (AOI)"), (2, "???")], "id bigint, libelle_choisi string")
    got = {r.incident_id: r for r in cases.frame_projects(inc, choices).collect()}
    assert got[1].titre == "Reduire joints brases froids (aoi) — CMS 2" and got[1].qqoqcp_quoi.startswith("Joints")
    assert got[2].titre == "" and got[2].qqoqcp_quoi == "texte"
    framed = spark.createDataFrame([(1, " tri des lots ", "A"), (2, " ", "")], "projet_id bigint, containment string, containment_qui string")
    actions = cases.containment_actions(framed).collect()
    assert [(a.titre, a.priorite) for a in actions] == [("[CONTAINMENT] tri des lots", 1)]
    assert len(TREE_BRANCHES) == 5
