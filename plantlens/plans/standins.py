"""Factory tables derived from the generic test tables, in SQL both engines understand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantlens.functions.vocab import (
    BLAME_MARKERS,
    CONDITION_MARKERS,
    ROOT_MARKERS,
    SYMPTOM_MARKERS,
    TREE_BRANCHES,
)
from plantlens.session import read_table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(expression: str, values) -> str:
    """CASE that picks a value by a number 0..n-1."""
    arms = " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values))
    return f"(CASE {expression} {arms} END)"


# one plain example per marker and family word, so that every rule is met by some row
_PHRASES = (
    "", *ROOT_MARKERS, *CONDITION_MARKERS, *SYMPTOM_MARKERS, *BLAME_MARKERS,
    "absence de controle et manque de rigueur", "Défaut visible en été, pas de procédure",
)
_CAUSES = (
    "cause inconnue", "Température four trop haute", "Buse encrassé et usure", "pression basse", "fuite sur le vérin",
    "lot fournisseur humide", "densité du kraft", "colle trop froide, réglage oublié", "vitesse de consigne",
    "procédure absente", "PROGRAMME de la gamme", "tempe", "visite", "lotissement",
)

# Sensor stream: one series per event type, second parameter from the JSON text, gaps by rule.
SENSORS = """
SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
       CASE WHEN value <= 200 THEN value END AS spiky,
       CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) >= 30 THEN value END AS patchy,
       CASE WHEN EXTRACT(DAY FROM ts) <> 3 THEN value END AS outage,
       CASE WHEN value > 300 THEN value END AS nearly_dead,
       CAST(5 AS DOUBLE) AS frozen
FROM events
"""

# Past incidents: long texts with machine, type, severity and role.
PAST_INCIDENTS = """
SELECT d.doc_id AS id, d.source AS machine, d.lang AS type_incident, d.text AS description,
       CASE WHEN l.toxic = 1 THEN 'critique' WHEN l.quality = 1 THEN 'haute' WHEN l.quality = 0 THEN 'faible'
            ELSE 'inconnue' END AS severite,
       CASE d.doc_id % 4 WHEN 0 THEN 'operator' WHEN 1 THEN 'technician' WHEN 2 THEN 'Opérator' ELSE '' END
         AS cree_par_role
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

NEW_CASES = """
SELECT item_id AS id, concat('SRC', CAST(item_id % 20 AS STRING)) AS machine,
       CASE WHEN item_id % 3 = 0 THEN 'fr' ELSE 'en' END AS type_incident, text AS description,
       CASE item_id % 5 WHEN 0 THEN 'faible' WHEN 1 THEN 'moyenne' WHEN 2 THEN 'haute' WHEN 3 THEN 'critique'
            ELSE '' END AS severite,
       CASE item_id % 2 WHEN 0 THEN 'operator' ELSE 'ac_manager' END AS cree_par_role
FROM benchmark
"""

# Why-chains: one project per conversation, one branch each, one level per turn.
CHAINS = f"""
SELECT conv_id * 100 + turn AS id, conv_id AS projet_id, {pick("conv_id % 5", TREE_BRANCHES)} AS branche_m,
       CAST(turn + 1 AS INT) AS niveau, concat('Pourquoi ', CAST(turn + 1 AS STRING), ' ?') AS question,
       text AS reponse, CASE WHEN role = 'assistant' THEN 'cause_directe' ELSE 'symptome' END AS type_noeud,
       (role = 'assistant' AND length(text) % 3 = 0) AS est_cause_racine,
       CAST(40 + (conv_id * 7 + turn * 13) % 50 AS DOUBLE) / 100 AS confidence,
       CAST(1 AS BIGINT) AS entreprise_id
FROM conversations
"""

CHAIN_PROJECTS = """
SELECT conv_id AS id, conv_id AS incident_id,
       CASE WHEN count(*) > 5 THEN 'valide' WHEN count(*) > 3 THEN 'validation_en_cours' ELSE 'cadrage' END AS statut
FROM conversations GROUP BY conv_id
"""

CHAIN_INCIDENTS = """
SELECT conv_id AS id, concat('src', CAST(conv_id % 20 AS STRING)) AS machine,
       CASE WHEN conv_id % 2 = 0 THEN 'fr' ELSE 'en' END AS type_incident, text AS description,
       CASE conv_id % 4 WHEN 0 THEN 'faible' WHEN 1 THEN 'moyenne' WHEN 2 THEN 'haute' ELSE 'critique' END AS severite,
       CASE conv_id % 3 WHEN 0 THEN 'operator' ELSE 'technician' END AS cree_par_role
FROM conversations WHERE turn = 0
"""

# Votes on chain nodes and on projects, from the event stream.
FEEDBACK = """
SELECT event_id AS id, user_id * 100 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 8 AS chemin_id,
       CASE event_type WHEN 'error' THEN -1 WHEN 'view' THEN 0 ELSE 1 END AS decision
FROM events
"""

VALIDATIONS = """
SELECT event_id AS id, user_id AS projet_id,
       CASE event_type WHEN 'click' THEN 'technician' WHEN 'view' THEN 'maintenance' WHEN 'purchase' THEN 'production'
            ELSE 'ac_manager' END AS role_valideur,
       concat('v', CAST(user_id AS STRING)) AS nom_valideur,
       CASE WHEN value >= 15 THEN 'valide' ELSE 'refuse' END AS decision, '' AS commentaire, ts AS cree_le
FROM events
"""

PROJECTS = """
SELECT c_custkey AS id, c_custkey AS incident_id, c_name AS titre,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'validation_en_cours' WHEN 'MACHINERY' THEN 'cadrage'
            WHEN 'FURNITURE' THEN 'valide' WHEN 'HOUSEHOLD' THEN 'solution_propose' ELSE 'validation_en_cours' END AS statut,
       CASE WHEN c_acctbal > 5000 THEN concat('Remplacer ', repeat('le capteur ', 12), c_name)
            WHEN c_acctbal > 0 THEN c_name ELSE '' END AS solution_proposee,
       CASE WHEN c_acctbal > 1000 THEN round(c_acctbal * 3) ELSE CAST(0 AS DOUBLE) END AS cout_estime,
       CASE WHEN c_nationkey > 10 THEN CAST(c_nationkey AS DOUBLE) END AS temps_estime_jours,
       CASE WHEN c_acctbal > 3000 THEN round(c_acctbal * 11) END AS gain_estime_eur,
       CASE WHEN c_nationkey > 5 THEN CAST(c_nationkey AS DOUBLE) / 2 END AS gain_productivite
FROM customer
"""

TRANSITION_REQUESTS = """
SELECT o_orderkey AS request_id, o_custkey AS projet_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'valide' WHEN '2-HIGH' THEN 'refuse' WHEN '3-MEDIUM' THEN 'deploiement'
            WHEN '4-NOT SPECIFIED' THEN 'solution_propose' ELSE 'inconnu' END AS demande
FROM orders
"""

ORDER_INCIDENTS = """
SELECT o_orderkey AS id, concat('Machine ', CAST(o_custkey % 50 AS STRING)) AS machine,
       CASE WHEN o_totalprice > 100000 THEN concat('operateur ', CAST(o_custkey AS STRING)) ELSE '' END AS operateur_nom,
       concat('Commande ', CAST(o_orderkey AS STRING), ' ', o_orderpriority) AS description,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'critique' WHEN '2-HIGH' THEN 'haute' WHEN '3-MEDIUM' THEN 'moyenne'
            ELSE 'faible' END AS severite,
       CASE o_orderstatus WHEN 'O' THEN 'brut' WHEN 'P' THEN 'fiabilise' ELSE 'clos' END AS statut,
       o_orderdate AS cree_le, o_orderdate AS maj_le
FROM orders
"""

ACTIONS = """
SELECT o_orderkey AS id, o_custkey AS projet_id, concat(' action ', o_orderpriority, ' ') AS titre,
       CAST(substring(o_orderpriority, 1, 1) AS INT) AS priorite,
       CASE o_orderstatus WHEN 'F' THEN 'fait' WHEN 'P' THEN 'bloque' ELSE 'a_faire' END AS statut, o_orderdate AS cree_le
FROM orders
"""

WORDED_NODES = f"""
SELECT doc_id, CAST(doc_id % 5 + 1 AS INT) AS niveau,
       concat(text, ' ', {pick(f"doc_id % {len(_PHRASES)}", _PHRASES)}) AS reponse
FROM documents
"""

WORDED_CAUSES = f"""
SELECT doc_id, concat({pick(f"doc_id % {len(_CAUSES)}", _CAUSES)}, ' ', text) AS cause FROM documents
"""

RCA_CASES = f"""
SELECT doc_id AS id, lang AS defect_type, text, source AS validated_branch,
       CASE WHEN n_chars % 9 = 0 THEN '' ELSE concat('cause ', CAST(n_chars % 40 AS STRING)) END AS validated_root_cause,
       concat('2026-01-0', CAST(doc_id % 9 + 1 AS STRING), 'T08:00:00') AS created_at
FROM documents
"""

# Supervised history: machine, material and method features per sample with a cause label.
HISTORY_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price")
HISTORY = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_quantity AS M_machine_temperature, l_discount * 100 AS M_machine_pression,
       l_tax * 100 AS M_matiere_humidite, l_extendedprice / 1000 AS M_matiere_grammage,
       l_quantity - l_tax * 50 AS M_methode_vitesse,
       CASE WHEN l_quantity > 40 THEN 'Température four haute' WHEN l_quantity < 8 THEN 'Buse encrassé'
            WHEN l_discount >= 0.08 THEN 'pression basse' WHEN l_tax >= 0.07 THEN 'lot humide'
            WHEN l_extendedprice > 90000 THEN 'grammage kraft' WHEN l_tax <= 0.01 THEN 'densité colle'
            WHEN l_quantity > 30 THEN 'vitesse de consigne' ELSE 'autre' END AS cause_racine
FROM lineitem
"""


def load(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    """Register the named test tables as temporary views."""
    for t in tables or TABLES:
        read_table(spark, f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One stand-in table as a DataFrame (its source tables are found by name)."""
    load(spark, sf_dir, *[t for t in TABLES if t in sql])
    return spark.sql(sql)
