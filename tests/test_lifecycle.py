from pyspark.sql import functions as F

from plantlens.operators import cases
from plantlens.plans import lifecycle
from plantlens.sources import store


def test_from_signal_to_learned_case(spark):
    names = ("incidents", "projets_ac", "actions", "validations", "chemins_pourquoi", "feedback_chemins")
    tables = {t: store.empty(spark, t) for t in names}
    rows = spark.createDataFrame(
        [(" M3 Soudeuse ", "Defauts soudure", "fiabilise"), ("M5", "Plis", "fiabilise"), ("M7", "Panne", "brut")],
        "machine string, description string, statut string",
    )
    tables["incidents"] = store.append(tables["incidents"], rows, "incidents", ["machine"])
    assert [r.machine for r in tables["incidents"].orderBy("id").collect()] == ["M3 Soudeuse", "M5", "M7"]
    choices = spark.createDataFrame(
        [(1, "EMB-01 — Defaut de collage / soudure sac", None, "tri des lots"), (2, "autre", "Corriger plis", ""), (3, "BRA-01 — x", None, "x")],
        "id bigint, libelle_choisi string, titre string, containment string",
    )
    tables |= lifecycle.start_projects(tables, choices)
    assert {r.id: r.statut for r in tables["incidents"].collect()} == {1: "en_projet", 2: "en_projet", 3: "brut"}
    projects = {r.incident_id: r for r in tables["projets_ac"].collect()}
    assert projects[1].titre.startswith("Reduire defaut de collage") and projects[2].titre == "Corriger plis" and 3 not in projects
    assert [(a.titre, a.priorite) for a in tables["actions"].collect()] == [("[CONTAINMENT] tri des lots", 1)]

    new = tables["incidents"].where("statut = 'en_projet'")
    trees = cases.generate_trees(new, tables["incidents"].limit(0), tables["projets_ac"], tables["chemins_pourquoi"], tables["feedback_chemins"])
    owned = trees.join(tables["projets_ac"].select(F.col("incident_id").alias("case_id"), F.col("id").alias("projet_id")), "case_id")
    tables["chemins_pourquoi"] = cases.save_trees(tables["chemins_pourquoi"], owned)
    tables["projets_ac"] = tables["projets_ac"].withColumn("statut", F.lit("validation_en_cours"))
    pid = {i: r.id for i, r in projects.items()}
    votes = spark.createDataFrame(
        [(pid[1], "technician", "valide", 1), (pid[1], "production", "valide", 2), (pid[2], "maintenance", "refuse", 3)],
        "projet_id bigint, role_valideur string, decision string, no int",
    )
    tables["validations"] = store.append(tables["validations"], votes, "validations", ["projet_id", "role_valideur"])
    outcome = cases.record_outcomes(votes, tables["chemins_pourquoi"])
    tables["feedback_chemins"] = store.append(tables["feedback_chemins"], outcome, "feedback_chemins", ["chemin_id", "role_valideur"])
    before = {r.id: r.confidence for r in tables["chemins_pourquoi"].collect()}
    tables |= lifecycle.settle_votes(tables)
    assert {r.id: r.statut for r in tables["projets_ac"].collect()} == {pid[1]: "valide", pid[2]: "cadre"}
    assert {r.id: r.statut for r in tables["incidents"].collect()} == {1: "clos", 2: "en_projet", 3: "brut"}
    for r in tables["chemins_pourquoi"].collect():
        grown = r.confidence > before[r.id] + 1e-9
        assert grown == (r.projet_id == pid[1] and r.est_cause_racine)
    assert store.constraint_violations({k: v for k, v in tables.items() if k != "validations"}).count() == 0
