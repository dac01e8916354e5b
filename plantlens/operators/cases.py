"""Case-based reasoning: votes, weights, cause trees, learning, workflow transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantlens.functions.text import shorten
from plantlens.functions.vocab import (
    DEFECT_CATALOGUE,
    DEPTH,
    ROLE_GROUPS,
    SHEET_SENTENCES,
    STATUS_LABELS,
    TEMPLATES,
    TRANSITIONS,
    TREE_BRANCHES,
)
from plantlens.operators.similarity import find_similar
from plantlens.session import materialize
from plantlens.sources import store

# --- feedback ----------------------------------------------------------------


def vote_tally(feedback: DataFrame) -> DataFrame:
    """Votes per node: ``chemin_id, valid, refus, ajuste, net``."""
    return feedback.groupBy("chemin_id").agg(
        F.count_if(F.col("decision") == 1).alias("valid"),
        F.count_if(F.col("decision") == -1).alias("refus"),
        F.count_if(F.col("decision") == 0).alias("ajuste"),
        F.sum(F.col("decision").cast("long")).alias("net"),
    )


def path_weight(valid: str | Column = "valid", refus: str | Column = "refus") -> Column:
    """1 without votes, log-scaled bonus for approvals, 0.5 off per refusal, never below 0.1."""
    v = F.coalesce(F.col(valid) if isinstance(valid, str) else valid, F.lit(0))
    r = F.coalesce(F.col(refus) if isinstance(refus, str) else refus, F.lit(0))
    return F.greatest(F.lit(0.1), 1.0 + 0.3 * F.log1p(v) - 0.5 * r)


def node_weights(nodes: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every node with its tally and weight."""
    tally = vote_tally(feedback).withColumnRenamed("chemin_id", "id")
    joined = nodes.join(tally, "id", "left").na.fill(0, ["valid", "refus", "ajuste", "net"])
    return joined.withColumn("weight", path_weight())


def record_outcomes(votes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Feedback rows for the root nodes of voted projects: +1 for valide, -1 for refuse.

    Other decisions leave no trace.  ``votes``: projet_id, role_valideur, decision and
    optionally nom_valideur, commentaire.
    """
    cast = votes.where(F.col("decision").isin("valide", "refuse"))
    roots = nodes.where("est_cause_racine").select(F.col("id").alias("chemin_id"), "projet_id")
    spoken = F.concat(F.lit("Vote "), F.col("decision"), F.lit(" de "), F.col("role_valideur"))
    comment = F.coalesce(F.nullif("commentaire", F.lit("")), spoken) if "commentaire" in votes.columns else spoken
    name = F.coalesce("nom_valideur", F.lit("")) if "nom_valideur" in votes.columns else F.lit("")
    return cast.join(roots, "projet_id").select(
        "chemin_id", F.when(F.col("decision") == "valide", 1).otherwise(-1).alias("decision"),
        comment.alias("commentaire"), name.alias("valide_par"), "role_valideur",
    )


# --- roots, chains, rankings -------------------------------------------------


def branch_roots(nodes: DataFrame, first: bool = False) -> DataFrame:
    """Root of every (project, branch): the deepest flagged node, else the deepest node.

    With ``first`` it is the first flagged node from the top (the one whose votes weigh a path), else
    the deepest node.
    """
    row = F.struct(*[c for c in nodes.columns if c not in ("projet_id", "branche_m")])
    flagged = F.coalesce("est_cause_racine", F.lit(False))
    sign = F.when(flagged & F.lit(first), -1).otherwise(1)
    best = F.max_by(row, F.struct(flagged, sign * F.col("niveau"), sign * F.col("id"))).alias("_r")
    return nodes.groupBy("projet_id", "branche_m").agg(best).select("projet_id", "branche_m", "_r.*")


def branch_chains(nodes: DataFrame) -> DataFrame:
    """Answers of a branch from symptom to root as one arrow text (a chain has a few levels)."""
    steps = F.array_sort(F.collect_list(F.struct("niveau", "id", "reponse")))
    return nodes.groupBy("projet_id", "branche_m").agg(
        F.array_join(F.transform(steps, lambda s: s["reponse"]), " → ").alias("chaine")
    )


def ranked_branches(nodes: DataFrame, feedback: DataFrame) -> DataFrame:
    """Branches of each project by confidence of their root, with state and chain text."""
    roots = branch_roots(nodes)
    tally = vote_tally(feedback).select(F.col("chemin_id").alias("id"), "net")
    state = F.when(F.coalesce("net", F.lit(0)) > 0, "valide").otherwise("propose")
    table = roots.join(tally, "id", "left").join(branch_chains(nodes), ["projet_id", "branche_m"])
    order = Window.partitionBy("projet_id").orderBy(F.desc("confidence"), "branche_m")
    return table.select(
        "projet_id", F.row_number().over(order).cast("long").alias("rank"), "branche_m",
        F.col("id").alias("root_id"), "reponse", "confidence", state.alias("etat"), "chaine",
    )


def proposed_causes(nodes: DataFrame, fallback: int = 5) -> DataFrame:
    """Root nodes of each project by confidence; without any, its most confident nodes."""
    has_root = nodes.where("est_cause_racine").select("projet_id").distinct()
    order = Window.partitionBy("projet_id").orderBy(F.desc("confidence"), "id")
    others = nodes.join(has_root, "projet_id", "left_anti")
    others = others.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= fallback).drop("_r")
    return nodes.where("est_cause_racine").unionByName(others)


# --- trees -------------------------------------------------------------------


def _template_nodes(cases: DataFrame) -> DataFrame:
    """(case_id, branche_m) rows unfolded into the template chain of their branch."""
    steps = F.create_map(
        *[
            x
            for branch, chain in TEMPLATES.items()
            for x in (
                F.lit(branch),
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("niveau"), F.lit(q).alias("question"), F.lit(a).alias("reponse"),
                            F.lit(c).alias("confidence"),
                        )
                        for i, (q, a, c) in enumerate(chain, 1)
                    ]
                ),
            )
        ]
    )
    rows = cases.select("case_id", "branche_m", F.explode(F.element_at(steps, F.col("branche_m"))).alias("_s"))
    is_root = F.col("niveau") == DEPTH
    return rows.select("case_id", "branche_m", "_s.*").select(
        "case_id", "branche_m", "niveau", "question", "reponse", "confidence",
        F.when(is_root, "cause_racine").otherwise("cause_directe").alias("type_noeud"),
        is_root.alias("est_cause_racine"), F.lit(None).cast("bigint").alias("source_cas_id"),
        F.lit(None).cast("double").alias("similarite_cas"), F.lit("template_synthetique").alias("origine"),
    )


def best_paths(similar: DataFrame, projects: DataFrame, nodes: DataFrame, feedback: DataFrame) -> DataFrame:
    """Best past chain per (case, branch) by similarity x vote weight of its root.

    All projects of one incident share its similarity, so each (incident, branch) first shrinks
    to its best-weighted project; only those one-row groups meet the similar cases.
    """
    roots = branch_roots(nodes, first=True)
    weighted = roots.join(vote_tally(feedback).withColumnRenamed("chemin_id", "id"), "id", "left").select(
        "projet_id", "branche_m", path_weight().alias("weight")
    )
    of_incident = weighted.join(
        projects.where(F.col("incident_id").isNotNull()).select(F.col("id").alias("projet_id"), "incident_id"), "projet_id"
    )
    best = of_incident.groupBy("incident_id", "branche_m").agg(
        F.max(F.struct("weight", (-F.col("projet_id")).alias("_neg"))).alias("_b")
    ).select(F.col("incident_id").alias("id"), "branche_m", "_b.weight", (-F.col("_b._neg")).alias("projet_id"))
    scored = similar.join(best, "id").withColumn("score", F.col("similarity") * F.col("weight"))
    order = Window.partitionBy("case_id", "branche_m").orderBy(F.desc("score"), "rank")
    return (
        scored.withColumn("_r", F.row_number().over(order)).where("_r = 1")
        .select("case_id", "branche_m", F.col("id").alias("source_cas_id"), "similarity", "weight", "score", "projet_id")
    )


def generate_trees(
    new_cases: DataFrame,
    history: DataFrame,
    projects: DataFrame,
    nodes: DataFrame,
    feedback: DataFrame,
    top_k_similar: int = 3,
    min_similarity: float = 0.0,
    same_tenant: bool = False,
    exclude_self: bool = True,
) -> DataFrame:
    """Why-trees of a batch of incidents: per branch the best past chain, else the template."""
    similar = find_similar(new_cases, history, top_k_similar, min_similarity, exclude_self, same_tenant)
    paths = materialize(best_paths(similar, projects, nodes, feedback))  # at most five rows per case, used twice
    past = paths.join(nodes.drop("source_cas_id", "similarite_cas"), ["projet_id", "branche_m"]).select(
        "case_id", "branche_m", F.col("niveau").cast("int").alias("niveau"), "question", "reponse",
        (F.col("confidence") * F.col("similarity")).alias("confidence"), "type_noeud", "est_cause_racine",
        F.col("source_cas_id").cast("bigint").alias("source_cas_id"), F.col("similarity").alias("similarite_cas"),
        F.lit("cas_historique").alias("origine"),
    )
    branches = F.explode(F.array(*[F.lit(b) for b in TREE_BRANCHES])).alias("branche_m")
    wanted = new_cases.select(F.col("id").cast("bigint").alias("case_id"), branches)
    cold = wanted.join(paths.select("case_id", "branche_m"), ["case_id", "branche_m"], "left_anti")
    return past.unionByName(_template_nodes(cold))


def tree_confidence(tree: DataFrame) -> DataFrame:
    """Mean confidence per branch, and their mean per case."""
    per_branch = tree.groupBy("case_id", "branche_m").agg(F.avg("confidence").alias("branch_confidence"))
    return per_branch.withColumn(
        "global_confidence", F.avg("branch_confidence").over(Window.partitionBy("case_id"))
    )


def save_trees(nodes: DataFrame, trees: DataFrame, replace_existing: bool = True) -> DataFrame:
    """Node table with the new trees: old nodes of the projects removed, parents chained.

    ``trees``: tree rows with ``projet_id``.
    """
    kept = store.delete_nodes(nodes, trees.select("projet_id").distinct()) if replace_existing else nodes
    fresh = store.append(nodes, trees, "chemins_pourquoi", ["projet_id", "branche_m", "niveau"])
    return kept.unionByName(store.chain_parents(fresh))


def store_trees(spark: SparkSession, path: str, trees: DataFrame, replace_existing: bool = True) -> None:
    """Write new trees (with ``projet_id``) to a stored node table (``store.write_grouped`` by ``projet_id``).

    Nodes get ids after the largest stored one and links to their parents; old nodes of the projects are removed, and no
    folder without such a project is read in full or written.
    """
    nodes = store.read_grouped(spark, path)
    fresh = store.chain_parents(store.append(nodes, trees, "chemins_pourquoi", ["projet_id", "branche_m", "niveau"]))
    if not replace_existing:
        projects = trees.select("projet_id").distinct()
        fresh = fresh.unionByName(nodes.join(projects, "projet_id", "left_semi"))
    store.replace_groups(spark, path, fresh, "projet_id", trees.select("projet_id").distinct())


def enrich_validated(projects: DataFrame, nodes: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Learn from validated projects.

    Returns patches for the nodes (confidence x weight, at most 0.95), patches for the incidents
    (``clos``), and a report with the number of nodes and incidents per project.
    """
    done = projects.select(F.col("id").alias("projet_id"), "incident_id")
    touched = node_weights(nodes, feedback).join(done.select("projet_id"), "projet_id", "left_semi")
    node_patches = touched.select("id", F.least(F.lit(0.95), F.col("confidence") * F.col("weight")).alias("confidence"))
    incident_patches = done.where(F.col("incident_id").isNotNull()).select(
        F.col("incident_id").alias("id"), F.lit("clos").alias("statut")
    ).distinct()
    counted = touched.groupBy("projet_id").agg(F.count(F.lit(1)).alias("noeuds_enrichis"))
    report = done.join(counted, "projet_id", "left").select(
        "projet_id", F.coalesce("noeuds_enrichis", F.lit(0)).alias("noeuds_enrichis"),
        F.col("incident_id").isNotNull().cast("int").alias("incidents_marques"),
    )
    return node_patches, incident_patches, report


def correct_nodes(nodes: DataFrame, corrections: DataFrame) -> DataFrame:
    """Manual corrections (answer text, root flag); empty texts change nothing."""
    cleaned = corrections.withColumn("reponse", F.trim("reponse")).where(F.col("reponse") != "")
    return store.apply_patches(nodes, cleaned, "chemins_pourquoi")


# --- votes and workflow ------------------------------------------------------


def role_group(column: str = "role_valideur") -> Column:
    pairs = [F.lit(x) for kv in ROLE_GROUPS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


def latest_votes(validations: DataFrame) -> DataFrame:
    """Latest decision per project and role group (technical, production)."""
    grouped = validations.withColumn("vote_group", role_group()).where(F.col("vote_group").isNotNull())
    vote = F.struct("decision", F.col("cree_le").alias("voted_at"), F.coalesce("nom_valideur", F.lit("")).alias("voted_by"))
    return (
        grouped.groupBy("projet_id", "vote_group")
        .agg(F.max_by(vote, F.struct("cree_le", "id")).alias("_v"))
        .select("projet_id", "vote_group", "_v.*")
    )


def validation_state(projects: DataFrame, validations: DataFrame) -> DataFrame:
    """Per project: who voted what, whether all agreed, whether anyone refused."""
    votes = latest_votes(validations)
    sides = votes.groupBy("projet_id").agg(
        *[
            F.max(F.when(F.col("vote_group") == g, F.col(c))).alias(f"{g}_{c}")
            for g in ("tech", "prod")
            for c in ("decision", "voted_at", "voted_by")
        ],
        *[F.max(F.col("vote_group") == g).alias(f"{g}_done") for g in ("tech", "prod")],
    )
    joined = projects.select(F.col("id").alias("projet_id"), "statut").join(sides, "projet_id", "left")
    no = F.lit(False)

    def said(value: str) -> list[Column]:
        return [F.coalesce(F.col(f"{g}_decision") == value, no) for g in ("tech", "prod")]

    valid, refused = said("valide"), said("refuse")
    return joined.withColumns(
        {
            "tech_done": F.coalesce("tech_done", no), "prod_done": F.coalesce("prod_done", no),
            "all_valid": valid[0] & valid[1], "any_refused": refused[0] | refused[1],
        }
    )


def apply_votes(state: DataFrame) -> DataFrame:
    """Outcome of complete votes: new status and result; only projects under validation move."""
    under_vote = F.col("statut") == "validation_en_cours"
    result = F.when(F.col("any_refused") & under_vote, "refuse_back_to_cadrage").when(
        ~F.col("any_refused") & F.col("all_valid") & under_vote, "valide"
    )
    new_status = F.when(result == "refuse_back_to_cadrage", "cadre").when(result == "valide", "valide").otherwise(
        F.col("statut")
    )
    return state.select("projet_id", "statut", new_status.alias("nouveau_statut"), result.alias("resultat"))


def pending_votes(projects: DataFrame, validations: DataFrame) -> DataFrame:
    """Projects each role group still has to vote on."""
    groups = F.explode(F.array(F.lit("tech"), F.lit("prod"))).alias("vote_group")
    due = projects.select(F.col("id").alias("projet_id"), groups)
    return due.join(latest_votes(validations).select("projet_id", "vote_group"), ["projet_id", "vote_group"], "left_anti")


def _next_states(status: Column) -> Column:
    """Sorted successor states of a status; NULL for an unknown one."""
    successors = {s: sorted(d for a, d in TRANSITIONS if a == s) for s in STATUS_LABELS}
    pairs = [x for s, d in successors.items() for x in (F.lit(s), F.array(*[F.lit(v) for v in d]).cast("array<string>"))]
    return F.try_element_at(F.create_map(*pairs), status)


def check_transitions(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Judge requested status changes: ``projet_id, statut, demande, ok, raison``.

    Unknown projects and unknown states are refused with a reason, like forbidden steps.
    """
    current = projects.select(F.col("id").alias("projet_id"), "statut")
    joined = requests.select("projet_id", "demande").join(current, "projet_id", "left")
    allowed = _next_states(F.col("statut"))
    ok = F.coalesce(F.array_contains(allowed, F.col("demande")), F.lit(False))
    listed = F.when(
        F.size(F.coalesce(allowed, F.array().cast("array<string>"))) > 0,
        F.concat(F.lit("['"), F.array_join(allowed, "', '"), F.lit("']")),
    ).otherwise(F.lit("aucun"))
    reason = F.when(
        F.col("statut").isNull(), F.concat(F.lit("Projet "), F.col("projet_id").cast("string"), F.lit(" introuvable"))
    ).when(
        ~ok,
        F.concat(
            F.lit("Transition interdite : "), F.col("statut"), F.lit(" → "), F.col("demande"),
            F.lit(". Suivants possibles : "), listed,
        ),
    ).otherwise(F.lit(""))
    return joined.select("projet_id", "statut", "demande", ok.alias("ok"), reason.alias("raison"))


# --- framing and reporting ---------------------------------------------------


def defect_catalogue(spark) -> DataFrame:
    return spark.createDataFrame(list(DEFECT_CATALOGUE), "code string, libelle string, famille string, quoi string")


def frame_projects(incidents: DataFrame, choices: DataFrame) -> DataFrame:
    """Prefilled project rows for incidents framed with a catalogue defect.

    ``choices``: ``id`` (incident) and ``libelle_choisi`` ("code — label"); an unknown label
    falls back to the free entry.
    """
    catalogue = F.broadcast(defect_catalogue(incidents.sparkSession))
    code = F.split("libelle_choisi", " — ")[0]
    known = [c for c, *_ in DEFECT_CATALOGUE]
    picked = choices.withColumn("code", F.when(code.isin(known), code).otherwise(known[-1]))
    joined = incidents.join(picked, "id").join(catalogue, "code")
    title = F.when(
        F.col("code") != "AUT-00",
        F.concat(F.lit("Reduire "), F.lower("libelle"), F.lit(" — "), F.coalesce("machine", F.lit(""))),
    ).otherwise(F.lit(""))
    signalled = F.coalesce("operateur_nom", F.lit(""))
    return joined.select(
        F.col("id").alias("incident_id"), "code", title.alias("titre"),
        F.coalesce(F.nullif("quoi", F.lit("")), F.substring(F.coalesce("description", F.lit("")), 1, 120)).alias("qqoqcp_quoi"),
        F.coalesce("machine", F.lit("")).alias("qqoqcp_ou"),
        F.when(signalled != "", F.concat(F.lit("Signale par "), signalled)).otherwise(F.lit("")).alias("qqoqcp_qui"),
    )


def containment_actions(framed: DataFrame) -> DataFrame:
    """Priority-1 protection actions of framed projects that name one.

    ``framed``: projet_id, containment, containment_qui.
    """
    text = F.trim(F.coalesce("containment", F.lit("")))
    return framed.where(text != "").select(
        "projet_id", F.concat(F.lit("[CONTAINMENT] "), text).alias("titre"),
        F.trim(F.coalesce("containment_qui", F.lit(""))).alias("assignee"), F.lit(1).alias("priorite"),
    )


def action_kpis(actions: DataFrame) -> DataFrame:
    done = F.count_if(F.col("statut") == "fait")
    total = F.count(F.lit(1))
    return actions.agg(
        total.alias("n_total"), done.alias("n_fait"), F.count_if(F.col("statut") == "bloque").alias("n_bloque"),
        F.coalesce(F.try_divide(done, total) * 100.0, F.lit(0.0)).alias("pct_fait"),
    )


def incident_kpis(incidents: DataFrame) -> DataFrame:
    return incidents.agg(
        F.count_if(F.col("statut") == "brut").alias("n_brut"),
        F.count_if(F.col("statut") == "fiabilise").alias("n_fiabilise"), F.count(F.lit(1)).alias("n_total"),
    )


def case_kpis(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count_if(F.coalesce("validated_root_cause", F.lit("")) != "").alias("n_validated"),
    )


def solution_sheets(projects: DataFrame) -> DataFrame:
    """The proposed solution worded for each role: ``projet_id, role, line, text``.

    A sentence with a blank is used when its figure is given and not zero, else the one without, if there is one.
    """
    solution = F.trim(F.coalesce("solution_proposee", F.lit("")))

    def figure(c: str, shown: Column) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, shown)

    def whole(c: str) -> Column:
        return figure(c, F.translate(F.format_number(F.col(c), 0), ",", " "))

    own = F.when(solution != "", shorten(solution))
    blanks = {
        "production": (
            whole("gain_estime_eur"), figure("gain_productivite", F.format_string("%.1f", F.col("gain_productivite"))),
            figure("temps_estime_jours", F.format_number("temps_estime_jours", 0)), whole("cout_estime"),
        ),
        "technician": (own, None, None),
        "operator": (own, None, None),
    }

    def sentence(filled: str | None, plain: str | None, value: Column | None) -> Column:
        if filled is None:
            return F.lit(plain)
        before, after = filled.split("{}")
        return F.coalesce(F.concat(F.lit(before), value, F.lit(after)), F.lit(plain))

    lines = {r: [sentence(*pair, value) for pair, value in zip(SHEET_SENTENCES[r], blanks[r], strict=True)] for r in SHEET_SENTENCES}
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.array_compact(F.array(*ls)).alias("lines")) for r, ls in lines.items()])
    unfolded = projects.select(F.col("id").alias("projet_id"), F.explode(roles).alias("_r"))
    return unfolded.select("projet_id", "_r.role", F.posexplode("_r.lines").alias("line", "text"))
