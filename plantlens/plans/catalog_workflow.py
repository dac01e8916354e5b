"""Registered queries of workflow steps, printed tables and lists (see ``catalog`` for the form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.functions import report, text
from plantlens.functions.spc_values import PATTERN_LABELS
from plantlens.functions.vocab import FORM_BRANCHES
from plantlens.operators import autofill, cases, losses, shifts, similarity, spc
from plantlens.plans import analysis, lifecycle, standins
from plantlens.plans.catalog import (
    LINE_POINTS,
    ORACLE,
    PARAMETERS,
    SHEWHART_SQL,
    STATS,
    _KRUSKAL,
    _SPECS,
    _choices,
    _similar_sql,
    lineitem,
    query,
    rounded,
    sensors,
)
from plantlens.plans.standins import frame, quoted
from plantlens.session import read_table
from plantlens.sources import store

_USABLE_SPECS = {p: v for p, v in _SPECS.items() if p in PARAMETERS and v[0] < v[1]}


# --- workflow steps ----------------------------------------------------------

_CORRECTIONS = f"""
SELECT id, CASE id % 3 WHEN 0 THEN concat('  corrige ', CAST(id AS STRING), ' ') WHEN 1 THEN '   ' END AS reponse, niveau = 1 AS est_cause_racine
FROM ({standins.CHAINS}) c
"""


@query(
    f"WITH n AS ({standins.CHAINS}) SELECT id, CASE WHEN id % 3 = 0 THEN 'corrige ' || id ELSE reponse END AS reponse, "
    "CASE WHEN id % 3 = 0 THEN niveau = 1 ELSE est_cause_racine END AS est_cause_racine, id % 3 = 0 AS changed FROM n"
)
def corrected_nodes(spark, d):
    """Manual corrections of answers and root flags; empty texts change nothing."""
    done = cases.correct_nodes(frame(spark, d, standins.CHAINS), frame(spark, d, _CORRECTIONS))
    return done.select("id", "reponse", "est_cause_racine", "changed")


_CLEARING = f"""
SELECT id, 1 AS patch_no, concat('projet ', CAST(id AS STRING)) AS titre, CAST(array('gain_estime_eur') AS ARRAY<STRING>) AS cleared FROM ({standins.PROJECTS}) p
UNION ALL SELECT id, 2, CAST(NULL AS STRING), CASE WHEN cout_estime = 0 THEN array('solution_proposee', 'cout_estime') END FROM ({standins.PROJECTS}) p
UNION ALL SELECT id, 3, CASE WHEN statut = 'cadrage' THEN 'dernier' END, array('statut', 'incident_id') FROM ({standins.PROJECTS}) p
"""


@query(
    f"WITH p AS ({standins.PROJECTS}) SELECT id, incident_id, CASE WHEN statut = 'cadrage' THEN 'dernier' ELSE 'projet ' || id END AS titre, CAST(NULL AS VARCHAR) AS statut, "
    "CASE WHEN cout_estime <> 0 THEN solution_proposee END AS solution_proposee, CASE WHEN cout_estime <> 0 THEN cout_estime END AS cout_estime, "
    "CAST(NULL AS DOUBLE) AS gain_estime_eur, temps_estime_jours, true AS changed FROM p"
)
def cleared_fields(spark, d):
    """Patches that set fields to NULL; the later patch wins, refused columns stay."""
    rows = store.apply_patches(frame(spark, d, standins.PROJECTS), frame(spark, d, _CLEARING), "projets_ac")
    return rows.select("id", "incident_id", "titre", "statut", "solution_proposee", "cout_estime", "gain_estime_eur", "temps_estime_jours", "changed")


_STARTED = (
    f"i AS ({standins.ORDER_INCIDENTS}), f AS ({ORACLE['framed_projects']}), "
    "t AS (SELECT f.*, CASE WHEN f.incident_id % 4 = 0 THEN 'Titre ' || f.incident_id ELSE f.titre END AS chosen FROM f JOIN i ON i.id = f.incident_id WHERE i.statut = 'fiabilise'), "
    "p AS (SELECT row_number() OVER (ORDER BY incident_id) AS id, incident_id, chosen AS titre, 'cadrage' AS statut, qqoqcp_quoi FROM t WHERE chosen <> '')"
)


def _started(spark, d):
    incidents = frame(spark, d, standins.ORDER_INCIDENTS)
    number = F.col("id").cast("string")
    choices = _choices(incidents).withColumns({
        "titre": F.when(F.col("id") % 4 == 0, F.concat(F.lit(" Titre "), number, F.lit(" "))),
        "containment": F.when(F.col("id") % 3 == 0, F.concat(F.lit(" tri "), number)).otherwise(" "),
        "containment_qui": F.when(F.col("id") % 2 == 0, F.lit(" equipe ")),
    })
    tables = {"incidents": incidents, "projets_ac": store.empty(spark, "projets_ac"), "actions": store.empty(spark, "actions")}
    return lifecycle.start_projects(tables, choices)


@query(f"WITH {_STARTED} SELECT id, incident_id, titre, statut, qqoqcp_quoi FROM p")
def projects_started(spark, d):
    """Projects opened from framed incidents, with chosen or suggested titles."""
    return _started(spark, d)["projets_ac"].select("id", "incident_id", "titre", "statut", "qqoqcp_quoi")


@query(f"WITH {_STARTED} SELECT i.id, machine, CASE WHEN p.id IS NOT NULL THEN 'en_projet' ELSE i.statut END AS statut FROM i LEFT JOIN p ON p.incident_id = i.id")
def incidents_in_project(spark, d):
    return _started(spark, d)["incidents"].select("id", "machine", "statut")


@query(
    f"WITH {_STARTED} SELECT row_number() OVER (ORDER BY id) AS id, id AS projet_id, '[CONTAINMENT] tri ' || incident_id AS titre, CASE WHEN incident_id % 2 = 0 THEN 'equipe' ELSE '' END AS assignee, "
    "CAST(1 AS BIGINT) AS priorite FROM p WHERE incident_id % 3 = 0"
)
def protections_opened(spark, d):
    return rounded(_started(spark, d)["actions"].select("id", "projet_id", "titre", "assignee", "priorite"))


def _settled(spark, d):
    return lifecycle.settle_votes({
        "projets_ac": frame(spark, d, standins.PROJECTS), "validations": frame(spark, d, standins.VALIDATIONS), "chemins_pourquoi": frame(spark, d, standins.CHAINS),
        "feedback_chemins": frame(spark, d, standins.FEEDBACK), "incidents": frame(spark, d, standins.ORDER_INCIDENTS),
    })


_MOVED = f"p AS ({standins.PROJECTS}), o AS ({ORACLE['apply_votes']}), m AS (SELECT p.id, p.incident_id, coalesce(o.nouveau_statut, p.statut) AS statut, o.resultat FROM p LEFT JOIN o ON o.projet_id = p.id AND o.resultat IS NOT NULL)"


@query(f"WITH {_MOVED} SELECT id, statut FROM m")
def projects_settled(spark, d):
    """Status of every project after the votes were counted."""
    return _settled(spark, d)["projets_ac"].select("id", "statut")


@query(f"WITH {_MOVED}, i AS ({standins.ORDER_INCIDENTS}) SELECT i.id, CASE WHEN i.id IN (SELECT incident_id FROM m WHERE resultat = 'valide') THEN 'clos' ELSE statut END AS statut FROM i")
def incidents_settled(spark, d):
    return _settled(spark, d)["incidents"].select("id", "statut")


# --- printed tables and dashboard --------------------------------------------


@query(
    f"WITH c AS ({ORACLE['capability_cpk']}) SELECT substring(parameter, 1, 25) AS parametre, format('{{:.2f}}', lsl) AS lsl, format('{{:.2f}}', usl) AS usl, format('{{:.3f}}', cpk) AS cpk, verdict FROM c"
)
def report_cpk(spark, d):
    """Capability rows as printed."""
    return report.cpk_rows(losses.cpk(lineitem(spark, d), losses.specs_frame(spark, _USABLE_SPECS), ["l_linestatus"]))


@query(
    f"WITH c AS ({ORACLE['loss_analysis']}) SELECT parameter AS parametre, CAST(n AS VARCHAR) AS n, test_retenu AS test, coalesce(format('{{:.3f}}', spearman_r), '-') AS r, "
    "coalesce(format('{:.4f}', spearman_p), '-') AS p_value FROM c"
)
def report_correlation_table(spark, d):
    """Correlation rows as printed, with the retained test."""
    gappy = frame(spark, d, "SELECT *, NULLIF(event_type, 'click') AS kind, CASE WHEN user_id < 0 THEN CAST(1 AS DOUBLE) END AS absent FROM (" + standins.SENSORS + ") x")
    return report.correlation_rows(losses.correlations(gappy, ["k", "patchy", "user_id", "frozen", "absent"], "value", ["kind"]))


# three shifts: two degrees of freedom, so the tail is exp(-h / 2)
@query(
    f"{_KRUSKAL} SELECT parameter AS parametre, 'Kruskal-Wallis' AS test, format('{{:.2f}}', h) AS statistique, format('{{:.4f}}', exp(-h / 2)) AS p_value, "
    "CASE WHEN exp(-h / 2) < 0.05 THEN 'OUI' ELSE 'non' END AS significatif FROM kw WHERE n_shifts = 3"
)
def report_shifts(spark, d):
    """Shift rows as printed."""
    return report.shift_rows(shifts.compare_shifts(lineitem(spark, d), "l_returnflag", PARAMETERS))


@query(
    f"WITH {LINE_POINTS}, {STATS}, {SHEWHART_SQL}, sp(parameter, lsl, usl) AS (VALUES "
    + ", ".join(f"('{p}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for p, (a, b) in _USABLE_SPECS.items())
    + "), k AS (SELECT least((usl - mean) / (3 * sd), (mean - lsl) / (3 * sd)) AS cpk FROM sp JOIN st ON st.parameter = sp.parameter) "
    "SELECT (SELECT count(*) FROM lineitem) AS n_points, CAST(8 AS BIGINT) AS n_params, (SELECT CAST(sum(violations) AS BIGINT) FROM v) AS n_alerts, "
    "(SELECT round(sum(l_tax) / sum(l_quantity) * 1000000, 4) FROM lineitem) AS ppm, (SELECT round(avg(cpk), 4) FROM k) AS cpk_mean, (SELECT round(avg(cpk), 4) FROM k) AS cpk_mean_finite"
)
def dashboard_quality(spark, d):
    """Dashboard row with defect rate and mean capability."""
    rows = lineitem(spark, d)
    control = spc.shewhart(rows, PARAMETERS)
    table = losses.cpk(rows, losses.specs_frame(spark, _USABLE_SPECS))
    return rounded(analysis.dashboard_kpis(rows, control, table, losses.ppm(rows, "l_tax", "l_quantity")), 4)


@query(
    f"WITH c AS ({ORACLE['spc_nelson_by_series']}) SELECT event_type, parameter, dominant_pattern, CASE dominant_pattern "
    + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in PATTERN_LABELS.items()) + " ELSE dominant_pattern END AS libelle FROM c"
)
def pattern_labels(spark, d):
    """Wording of the dominant pattern of every series."""
    results = spc.analyze_all(sensors(spark, d), ["value", "k"], ["event_type"], ["event_id"])
    return results.select("event_type", "parameter", "dominant_pattern", spc.pattern_label().alias("libelle"))


@query(
    f"WITH n AS ({standins.CHAINS}) SELECT id, branche_m, CASE branche_m " + " ".join(f"WHEN {quoted(b)} THEN '{m}'" for b, m in FORM_BRANCHES.items()) + " ELSE 'manuel' END AS mode FROM n"
)
def branch_modes(spark, d):
    return frame(spark, d, standins.CHAINS).select("id", "branche_m", autofill.branch_mode("branche_m").alias("mode"))


@query(
    "SELECT d.doc_id, trim(CASE WHEN l.quality IS NULL THEN coalesce(text, '') ELSE coalesce(text, '') || chr(10) || '--- IA V2 ---' || chr(10) || '[IA Machine] top1=' || source || ' (' || "
    "(25 + 50 * l.quality) || '%)' || chr(10) || '[IA Methode] top1=' || lang || ' (10%)' END) AS contexte FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
)
def contexts_with_traces(spark, d):
    """Contexts followed by the trace lines of predictions, where there are any."""
    labels = read_table(spark, f"{d}/labels.parquet").select("doc_id", "quality")
    docs = read_table(spark, f"{d}/documents.parquet").join(labels, "doc_id", "left")
    first = text.trace_line(F.lit("Machine"), F.col("source"), (F.lit(0.25) + F.col("quality") * 0.5))
    lines = F.when(F.col("quality").isNotNull(), F.array(first, text.trace_line(F.lit("Methode"), F.col("lang"), F.lit(0.1)))).otherwise(F.array().cast("array<string>"))
    return docs.withColumn("traces", lines).select("doc_id", F.trim(text.enriched_context("text", "traces")).alias("contexte"))


# --- lists -------------------------------------------------------------------

_AXIS = "CASE event_type WHEN 'click' THEN 'Machine' WHEN 'view' THEN 'Matiere' ELSE 'Methode' END"
_PREDICTED = f"SELECT event_id AS id, user_id AS defaut_id, {_AXIS} AS m_axis, CAST(event_id % 3 + 1 AS INT) AS rank FROM events"
_DATED_VERSIONS = (
    "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Machine' WHEN 1 THEN 'Matiere' ELSE 'Methode' END AS m_axis, p_name AS version, "
    "concat('2026-01-', CAST(10 + p_size % 20 AS STRING)) AS training_date FROM part"
)


@query(f"WITH p AS ({_PREDICTED}) SELECT id, defaut_id, m_axis, CAST(rank AS BIGINT) AS rank FROM p WHERE defaut_id IN (SELECT c_custkey FROM customer)")
def predictions_of_defects(spark, d):
    """Stored predictions of a batch of defects."""
    defects = read_table(spark, f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"))
    return rounded(store.predictions_of(frame(spark, d, _PREDICTED), defects))


@query(f"WITH v AS ({_DATED_VERSIONS}) SELECT * FROM v WHERE m_axis = 'Machine'")
def model_version_list(spark, d):
    return store.model_versions(frame(spark, d, _DATED_VERSIONS), "Machine")


@query(f"WITH l AS ({ORACLE['last_values']}) SELECT event_type, parameter, CASE parameter WHEN 'k' THEN 2 * value ELSE value END AS value FROM l")
def merged_contexts(spark, d):
    """Defect contexts of two files: the later file wins for the same parameter."""
    rows = sensors(spark, d)
    first = autofill.last_values(rows.select("event_type", "event_id", "value", "k", "patchy", "nearly_dead"), ["event_id"], ["event_type"])
    later = autofill.last_values(rows.select("event_type", "event_id", (F.col("k") * 2).alias("k")), ["event_id"], ["event_type"])
    return autofill.merge_contexts([first, later], ["event_type"]).where("parameter <> 'event_id'")


@query(
    "WITH "
    + _similar_sql(standins.CHAIN_INCIDENTS, standins.CHAIN_INCIDENTS, 3).replace("FROM q CROSS JOIN h LEFT JOIN", "FROM q JOIN h ON q.id <> h.id AND q.id % 3 = h.id % 3 LEFT JOIN")
    + " SELECT case_id, rank, id, round(similarity, 6) AS similarity FROM sim"
)
def similar_in_company(spark, d):
    """Every incident against all others of its company, itself left out."""
    incidents = frame(spark, d, standins.CHAIN_INCIDENTS).withColumn("entreprise_id", F.col("id") % 3)
    return rounded(similarity.find_similar(incidents, incidents, 3, exclude_self=True, same_tenant=True))


# --- fingerprint of a training set -------------------------------------------

_HASH_TEXT = " || '|' || ".join(
    f"'{c}=' || " + (f"coalesce(format('{{:.6f}}', CAST({c} AS DOUBLE)), '')" if kind == "double" else f"coalesce(CAST({c} AS VARCHAR), '')")
    for c, kind in sorted({
        "l_orderkey": "long", "l_linenumber": "long", "l_partkey": "long", "l_suppkey": "long", "price": "long", "M_machine_temperature": "double", "M_machine_pression": "double", "M_matiere_humidite": "double",
        "M_matiere_grammage": "double", "M_methode_vitesse": "double", "cause_racine": "string",
    }.items())
)

ORACLE["training_data_hash"] = (
    f"WITH h AS ({standins.HISTORY}), x AS (SELECT sha256({_HASH_TEXT}) AS d FROM h), "
    "s AS (SELECT count(*) AS rows, " + ", ".join(f"CAST(sum(CAST('0x' || substring(d, {1 + 7 * i}, 7) AS BIGINT)) AS BIGINT) AS s{i}" for i in range(9)) + " FROM x) "
    "SELECT rows, sha256(CAST(rows AS VARCHAR) || " + " || ".join(f"'-' || s{i}" for i in range(9)) + ") AS training_data_hash FROM s"
)
