"""Batch steps of the improvement workflow: from qualified incidents to learned cases.

Each step takes the current tables (name -> DataFrame) and returns the new versions of those it
changes; the caller writes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.operators import cases
from plantlens.session import materialize
from plantlens.sources import store


def start_projects(tables: dict[str, DataFrame], choices: DataFrame) -> dict[str, DataFrame]:
    """Open a project for every qualified incident that was framed with a title.

    ``choices``: incident ``id``, ``libelle_choisi`` and optionally ``titre`` (overrides the
    suggestion), ``containment``, ``containment_qui``.  Incidents move to ``en_projet`` and a named
    protection becomes a priority-1 action.
    """
    for c in ("titre", "containment", "containment_qui"):
        if c not in choices.columns:
            choices = choices.withColumn(c, F.lit(None).cast("string"))
    ready = tables["incidents"].where(F.col("statut") == "fiabilise")
    framed = cases.frame_projects(ready, choices.select("id", "libelle_choisi")).drop("code")
    asked = choices.select(F.col("id").alias("incident_id"), F.col("titre").alias("_titre"), "containment", "containment_qui")
    titled = framed.join(asked, "incident_id").withColumn(
        "titre", F.coalesce(F.nullif(F.trim("_titre"), F.lit("")), "titre")
    ).where(F.col("titre") != "")
    titled = materialize(titled.drop("_titre"))
    opened = materialize(
        store.append(tables["projets_ac"], titled.drop("containment", "containment_qui"), "projets_ac", ["incident_id"])
    )
    moved = opened.select(F.col("incident_id").alias("id"), F.lit("en_projet").alias("statut"))
    protections = opened.select("incident_id", F.col("id").alias("projet_id")).join(
        titled.select("incident_id", "containment", "containment_qui"), "incident_id"
    )
    actions = store.append(tables["actions"], cases.containment_actions(protections), "actions", ["projet_id"])
    return {
        "incidents": store.apply_patches(tables["incidents"], moved, "incidents").drop("changed"),
        "projets_ac": tables["projets_ac"].unionByName(opened),
        "actions": tables["actions"].unionByName(actions),
    }


def settle_votes(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Move projects whose votes are decisive and learn from the validated ones.

    Refused projects go back to framing.  Validated ones raise or lower the confidence of their
    nodes by the vote weights and close their incident.
    """
    state = cases.validation_state(tables["projets_ac"], tables["validations"])
    settled = materialize(cases.apply_votes(state).where(F.col("resultat").isNotNull()))
    moved = settled.select(F.col("projet_id").alias("id"), F.col("nouveau_statut").alias("statut"))
    projects = materialize(store.apply_patches(tables["projets_ac"], moved, "projets_ac").drop("changed"))
    validated = settled.where(F.col("resultat") == "valide").select(F.col("projet_id").alias("id"))
    done = projects.join(validated, "id", "left_semi")
    nodes, incidents, _ = cases.enrich_validated(done, tables["chemins_pourquoi"], tables["feedback_chemins"])
    return {
        "projets_ac": projects,
        "chemins_pourquoi": store.apply_patches(tables["chemins_pourquoi"], nodes, "chemins_pourquoi").drop("changed"),
        "incidents": store.apply_patches(tables["incidents"], incidents, "incidents").drop("changed"),
    }
