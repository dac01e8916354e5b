"""The relational store as tables of DataFrames: catalogue, appends, patches, constraint checks.

Rows live in Parquet (or any catalogue table); a change is a new version of the table computed
for a whole batch, never a row-by-row write.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.functions.vocab import FAMILIES, STATUS_LABELS
from plantlens.operators.ordered import previous_in_series, with_positions
from plantlens.session import materialize, named, null_safe_join


@dataclass(frozen=True)
class Table:
    """Columns and rules of one table.  ``checks`` are SQL conditions every row must meet."""

    ddl: str
    required: tuple[str, ...] = ()
    defaults: dict[str, object] = field(default_factory=dict)
    trimmed: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    references: dict[str, str] = field(default_factory=dict)  # column -> table (its id)
    unique: tuple[tuple[str, ...], ...] = ()
    unique_where: dict[str, str] = field(default_factory=dict)  # "a,b" -> condition
    patchable: tuple[str, ...] = ()
    stamp: str | None = None  # column set when a row is created
    touched: str | None = None  # column set when a row changes

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


def _one_of(column: str, values: Sequence[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


TABLES: dict[str, Table] = {
    "entreprises": Table(
        "id bigint, nom string, secteur string, actif boolean, cree_le timestamp",
        required=("nom",), defaults={"actif": True}, unique=(("nom",),), stamp="cree_le",
    ),
    "incidents": Table(
        "id bigint, operateur_nom string, machine string, type_incident string, description string, "
        "audio_transcript string, photo_path string, severite string, contexte_json string, statut string, "
        "cree_par_role string, cree_le timestamp, maj_le timestamp, entreprise_id bigint",
        required=("machine", "statut"),
        defaults={"severite": "moyenne", "statut": "brut", "entreprise_id": 1, "operateur_nom": "",
                  "type_incident": "", "description": "", "cree_par_role": ""},
        trimmed=("machine", "description", "operateur_nom", "type_incident"),
        patchable=("statut",), stamp="cree_le", touched="maj_le",
    ),
    "projets_ac": Table(
        "id bigint, incident_id bigint, titre string, qqoqcp_qui string, qqoqcp_quoi string, qqoqcp_ou string, "
        "qqoqcp_quand string, qqoqcp_comment string, qqoqcp_pourquoi string, causes_ia_json string, "
        "causes_validees string, solution_proposee string, cout_estime double, temps_estime_jours double, "
        "gain_estime_eur double, gain_productivite double, statut string, cree_par string, cree_par_role string, "
        "cree_le timestamp, maj_le timestamp, entreprise_id bigint",
        required=("titre", "statut"),
        defaults={"statut": "cadrage", "entreprise_id": 1, "cree_par": "", "cree_par_role": ""},
        trimmed=("titre",), references={"incident_id": "incidents"},
        patchable=(
            "titre", "qqoqcp_qui", "qqoqcp_quoi", "qqoqcp_ou", "qqoqcp_quand", "qqoqcp_comment", "qqoqcp_pourquoi",
            "causes_ia_json", "causes_validees", "solution_proposee", "cout_estime", "temps_estime_jours",
            "gain_estime_eur", "gain_productivite", "statut",
        ),
        stamp="cree_le", touched="maj_le",
    ),
    "validations": Table(
        "id bigint, projet_id bigint, role_valideur string, nom_valideur string, decision string, "
        "commentaire string, cree_le timestamp",
        required=("projet_id", "role_valideur"), defaults={"nom_valideur": "", "commentaire": ""},
        references={"projet_id": "projets_ac"}, stamp="cree_le",
    ),
    "actions": Table(
        "id bigint, projet_id bigint, titre string, description string, assignee string, priorite int, "
        "statut string, echeance date, termine_le timestamp, roi_reel_eur double, cree_le timestamp",
        required=("projet_id", "titre", "statut"),
        defaults={"priorite": 2, "statut": "a_faire", "description": "", "assignee": ""},
        trimmed=("titre", "description"), references={"projet_id": "projets_ac"},
        patchable=("titre", "description", "assignee", "priorite", "statut", "echeance", "termine_le", "roi_reel_eur"),
        stamp="cree_le",
    ),
    "chemins_pourquoi": Table(
        "id bigint, projet_id bigint, branche_m string, niveau int, question string, reponse string, "
        "parent_id bigint, type_noeud string, est_cause_racine boolean, source_cas_id bigint, "
        "similarite_cas double, confidence double, entreprise_id bigint, cree_le timestamp",
        required=("projet_id", "branche_m", "niveau", "question", "reponse"),
        defaults={"type_noeud": "cause_directe", "est_cause_racine": False, "confidence": 0.5, "entreprise_id": 1},
        trimmed=("question", "reponse"),
        references={"projet_id": "projets_ac", "parent_id": "chemins_pourquoi", "entreprise_id": "entreprises"},
        patchable=("question", "reponse", "type_noeud", "est_cause_racine", "confidence", "similarite_cas"),
        stamp="cree_le",
    ),
    "evidence": Table(
        "id bigint, chemin_id bigint, type string, contenu string, description string, confidence double, "
        "timestamp_source timestamp, cree_le timestamp",
        required=("chemin_id", "type"), defaults={"confidence": 0.5, "contenu": "", "description": ""},
        trimmed=("description",), references={"chemin_id": "chemins_pourquoi"}, stamp="cree_le",
    ),
    "feedback_chemins": Table(
        "id bigint, chemin_id bigint, decision int, commentaire string, valide_par string, role_valideur string, "
        "valide_le timestamp",
        required=("chemin_id", "decision"), defaults={"commentaire": "", "valide_par": "", "role_valideur": ""},
        checks={"decision": "decision IN (-1, 0, 1)"}, references={"chemin_id": "chemins_pourquoi"},
        stamp="valide_le",
    ),
    "rca": Table(
        "id bigint, defect_type string, context string, parameters_json string, causes_5m_json string, "
        "validated_root_cause string, validated_branch string, operator string, created_at string",
        required=("defect_type", "created_at"),
    ),
    "defauts": Table(
        "id bigint, timestamp string, operator_id string, ligne string, type_defaut string, severite int, "
        "commentaire string, raw_data_snapshot string",
        required=("timestamp", "operator_id", "ligne", "type_defaut", "severite"),
        checks={"severite": "severite BETWEEN 1 AND 5"},
    ),
    "model_versions": Table(
        "id bigint, m_axis string, version string, training_date string, training_data_hash string, nb_samples int, "
        "top3_accuracy double, onnx_path string, active boolean",
        required=("m_axis", "version", "training_date", "training_data_hash", "nb_samples", "top3_accuracy", "onnx_path"),
        defaults={"active": False},
        checks={"m_axis": _one_of("m_axis", FAMILIES), "top3_accuracy": "top3_accuracy BETWEEN 0 AND 1"},
        unique_where={"m_axis": "active"},
    ),
    "predictions": Table(
        "id bigint, defaut_id bigint, timestamp string, model_version_id bigint, m_axis string, rank int, "
        "cause_label string, probabilite double, shap_features string, inference_time_ms int, statut string",
        required=("defaut_id", "timestamp", "model_version_id", "m_axis", "rank", "cause_label", "probabilite",
                  "shap_features", "inference_time_ms", "statut"),
        checks={
            "m_axis": _one_of("m_axis", FAMILIES), "rank": "rank BETWEEN 1 AND 3",
            "probabilite": "probabilite BETWEEN 0 AND 1",
            "statut": _one_of("statut", ("proposee", "inconnu_low_conf")),
        },
        references={"defaut_id": "defauts", "model_version_id": "model_versions"},
    ),
    "feedback": Table(
        "id bigint, prediction_id bigint, defaut_id bigint, timestamp string, operator_id string, "
        "was_correct boolean, vraie_cause string, commentaire string",
        required=("defaut_id", "timestamp", "operator_id", "was_correct"),
        references={"prediction_id": "predictions", "defaut_id": "defauts"},
    ),
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table].schema)


def conform(rows: DataFrame, table: str, now: Column | None = None) -> DataFrame:
    """All columns of the table in order: defaults filled, text trimmed, creation time set."""
    t = TABLES[table]
    now = F.current_timestamp() if now is None else now
    cols = []
    for f in t.schema.fields:
        c = named(f.name) if f.name in rows.columns else F.lit(None)
        if f.name in t.trimmed:
            c = F.trim(c)
        if f.name in t.defaults:
            c = F.coalesce(c, F.lit(t.defaults[f.name]))
        if f.name in (t.stamp, t.touched):
            c = F.coalesce(c.cast("timestamp"), now)
        cols.append(c.cast(f.dataType).alias(f.name))
    return rows.select(*cols)


def row_violations(rows: DataFrame, table: str) -> DataFrame:
    """Missing required values and failed checks: ``table_name, rule, column, id``."""
    t = TABLES[table]
    found = [
        F.when(F.col(c).isNull(), F.struct(F.lit("not_null").alias("rule"), F.lit(c).alias("column")))
        for c in t.required
    ] + [
        F.when(~F.expr(condition), F.struct(F.lit("check").alias("rule"), F.lit(c).alias("column")))
        for c, condition in t.checks.items()
    ]
    schema = "table_name string, rule string, column string, id bigint"
    if not found:
        return rows.sparkSession.createDataFrame([], schema)
    return (
        rows.select(F.col("id").cast("bigint").alias("id"), F.explode(F.array_compact(F.array(*found))).alias("_v"))
        .select(F.lit(table).alias("table_name"), "_v.rule", "_v.column", "id")
    )


def accept(rows: DataFrame, table: str) -> DataFrame:
    """Rows that meet the table's own rules."""
    t = TABLES[table]
    ok = F.lit(True)
    for c in t.required:
        ok = ok & F.col(c).isNotNull()
    for condition in t.checks.values():
        ok = ok & F.coalesce(F.expr(condition), F.lit(True))
    return rows.where(ok)


def append(existing: DataFrame, rows: DataFrame, table: str, order: Sequence[str], now: Column | None = None) -> DataFrame:
    """New rows ready to be appended: conformed, valid, numbered after the largest id.

    Numbers follow ``order`` and are dense; they come from a range sort, not from one task.
    """
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last")).first()["_last"]
    fresh = accept(conform(rows, table, now), table).drop("id")
    placed = with_positions(fresh, [], list(order))
    return placed.select(
        *[
            (F.lit(last + 1) + F.col("pos")).cast("bigint").alias("id") if f.name == "id" else F.col(f.name)
            for f in TABLES[table].schema.fields
        ]
    )


def constraint_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Every broken rule of the given tables as one table: ``table_name, rule, column, id``."""
    parts = []
    for name, rows in tables.items():
        t = TABLES[name]
        parts.append(row_violations(rows, name))
        for column, target in t.references.items():
            if target in tables:
                keys = tables[target].select(F.col("id").alias(column)).where(F.col(column).isNotNull())
                orphans = rows.where(F.col(column).isNotNull()).join(keys, column, "left_anti")
                parts.append(_violation(orphans, name, "reference", column))
        groups = [("id",), *t.unique] + [tuple(k.split(",")) for k in t.unique_where]
        for group in groups:
            scope = rows.where(F.expr(t.unique_where[",".join(group)])) if ",".join(group) in t.unique_where else rows
            # rows without a value in the group's columns are never equal to each other
            given = scope.dropna("any", subset=list(group))
            repeated = given.groupBy(*group).agg(
                F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id")
            ).where("_n > 1")
            parts.append(_violation(repeated.withColumn("id", F.col("_id")), name, "unique", ",".join(group)))
    return reduce(DataFrame.unionByName, parts)


def _violation(rows: DataFrame, table: str, rule: str, column: str) -> DataFrame:
    return rows.select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.lit(column).alias("column"),
        F.col("id").cast("bigint").alias("id"),
    )


def apply_patches(rows: DataFrame, patches: DataFrame, table: str, now: Column | None = None) -> DataFrame:
    """Apply one batch of partial updates; a NULL in a patch leaves the value alone.

    ``patches`` has ``id``, any patchable columns, optionally ``cleared`` (names of columns to set to NULL) and
    ``patch_no`` (the later patch wins per column; in one patch a value wins over clearing).  Columns outside
    the table's list are ignored.  Adds ``changed``.
    """
    t = TABLES[table]
    clearing = "cleared" in patches.columns
    fields = [c for c in rows.columns if c in t.patchable and (c in patches.columns or clearing)]
    if not fields:
        return rows.withColumn("changed", F.lit(False))
    at = F.col("patch_no") if "patch_no" in patches.columns else F.lit(0)

    def mention(c: str) -> Column:
        value = F.col(c) if c in patches.columns else F.lit(None).cast(rows.schema[c].dataType)
        named = F.coalesce(F.array_contains("cleared", c), F.lit(False)) if clearing else F.lit(False)
        return F.max_by(F.struct(value.alias("v")), F.when(value.isNotNull() | named, at)).alias(f"_p_{c}")

    latest = patches.groupBy("id").agg(*[mention(c) for c in fields]).withColumn("_hit", F.lit(True))
    joined = rows.join(latest, "id", "left")
    now = F.current_timestamp() if now is None else now
    changed = F.coalesce("_hit", F.lit(False))
    cols = []
    for c in rows.columns:
        if c in fields:
            given = F.col(f"_p_{c}")
            cols.append(F.when(given.isNotNull(), given["v"].cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        elif c == t.touched:
            cols.append(F.when(changed, now).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return joined.select(*cols, changed.alias("changed"))


def delete_nodes(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes left after deleting whole projects, or single branches when targets name them."""
    on = ["projet_id"] + (["branche_m"] if "branche_m" in targets.columns else [])
    return nodes.join(targets.select(*on).distinct(), on, "left_anti")


# Folders a grouped table is dealt to by a hash of its key; the same for all writes of a table.
BUCKETS = 64
_BUCKET = "bucket_"


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(named(key)), F.lit(buckets)).cast("int"))


def write_grouped(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write a table whose rows are later replaced by ``key``: Parquet in ``buckets`` folders, whatever the number of keys."""
    dealt = _bucketed(rows, key, buckets)
    dealt.repartition(_BUCKET).write.partitionBy(_BUCKET).option("compression", "zstd").parquet(path)


def read_grouped(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(_BUCKET)


def replace_groups(spark: SparkSession, path: str, fresh: DataFrame, key: str, groups: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Rows of ``fresh`` take the place of all stored rows with their keys, and of those with keys in ``groups`` (``key``).

    Only the folders that hold such keys are read and written again; the others are not touched.  What is kept of them is
    stored apart before they are overwritten, in one job that is committed at its end.
    """
    fresh = materialize(_bucketed(fresh, key, buckets))
    gone = fresh.select(key)
    if groups is not None:
        gone = gone.unionByName(groups.select(key))
    gone = materialize(_bucketed(gone.distinct(), key, buckets))
    touched = [r[_BUCKET] for r in gone.select(_BUCKET).distinct().collect()]  # at most ``buckets``
    stored = spark.read.parquet(path)
    kept = materialize(null_safe_join(stored.where(F.col(_BUCKET).isin(touched)), gone.select(key), [key], "left_anti"))
    whole = kept.unionByName(fresh.select(*stored.columns))
    # a folder that loses all its rows still has to be overwritten, which needs a row in it; it is emptied by name instead
    left = {r[_BUCKET] for r in whole.select(_BUCKET).distinct().collect()}
    whole.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(_BUCKET).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket in sorted(set(touched) - left):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{_BUCKET}={bucket}"), True)
    spark.catalog.refreshByPath(path)


def list_rows(rows: DataFrame, table: str, **equals) -> DataFrame:
    """Rows of a table with equality filters (pushed to the scan), in its customary order."""
    for column, value in equals.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if table == "actions":
        return rows.orderBy("priorite", F.desc("cree_le"), F.desc("id"))
    if table == "chemins_pourquoi":
        return rows.orderBy("branche_m", "niveau", "id")
    if table == "evidence":
        return rows.orderBy("cree_le", "id")
    if table == "entreprises":
        return rows.where("actif").orderBy("nom")
    # newest first; the id breaks ties between equal stamps
    return rows.orderBy(F.desc(TABLES[table].stamp), F.desc("id"))


def root_cause_history(nodes: DataFrame, branch: str | None = None, tenant: int | None = None, limit: int | None = None) -> DataFrame:
    """Newest root causes, optionally of one branch or company."""
    rows = nodes.where("est_cause_racine")
    if branch is not None:
        rows = rows.where(F.col("branche_m") == branch)
    if tenant is not None:
        rows = rows.where(F.col("entreprise_id") == tenant)
    newest = rows.orderBy(F.desc("cree_le"), F.desc("id"))
    return newest if limit is None else newest.limit(limit)


def lookup(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with the given ids, for a batch of point lookups."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def open_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.where(F.col("statut").isin("brut", "fiabilise"))


def open_projects(projects: DataFrame) -> DataFrame:
    return projects.where(F.col("statut") != "clos")


def solvable_projects(projects: DataFrame) -> DataFrame:
    """Validated projects followed by those with a proposed solution."""
    validated = projects.where(F.col("statut") == "valide")
    return validated.unionByName(projects.where(F.col("statut") == "solution_propose"))


def status_label(column: str = "statut") -> Column:
    pairs = [F.lit(x) for kv in STATUS_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.col(column))


# --- stored root-cause cases -------------------------------------------------


def encode_rca(cases: DataFrame, now: Column | None = None) -> DataFrame:
    """Case maps as JSON text, ready to be stored."""
    stamp = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss")
    return cases.select(
        *[c for c in cases.columns if c not in ("parameters", "causes_5m", "created_at")],
        F.to_json("parameters").alias("parameters_json"), F.to_json("causes_5m").alias("causes_5m_json"),
        F.coalesce(F.nullif("created_at", F.lit("")), stamp).alias("created_at"),
    )


def decode_rca(rows: DataFrame) -> DataFrame:
    """Stored cases with their maps; missing text is empty, missing maps have no entries."""
    texts = ("context", "validated_root_cause", "validated_branch", "operator", "created_at")
    return rows.select(
        *[c for c in ("id", "defect_type") if c in rows.columns],
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in texts],
        F.from_json(F.coalesce("parameters_json", F.lit("{}")), "map<string,double>").alias("parameters"),
        F.from_json(F.coalesce("causes_5m_json", F.lit("{}")), "map<string,array<string>>").alias("causes_5m"),
    )


def latest_cases(cases: DataFrame, rows: int | None = None) -> DataFrame:
    """Analyses for display, newest first; ``rows`` asks for so many."""
    newest = cases.orderBy(F.desc("id"))
    return (newest if rows is None else newest.limit(rows)).select(
        "id", F.substring("created_at", 1, 10).alias("date"), "defect_type", "validated_branch",
        "validated_root_cause", "operator",
    )


# --- model versions and retention -------------------------------------------


def active_models(versions: DataFrame) -> DataFrame:
    return versions.where("active")


def activate_models(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Make the chosen versions the only active ones of their axis; other axes stay as they are."""
    picked = chosen.select("id").distinct().withColumn("_on", F.lit(True))
    marked = versions.join(picked, "id", "left")
    axes = marked.where("_on").select("m_axis").distinct().withColumn("_axis", F.lit(True))
    joined = marked.join(axes, "m_axis", "left")
    active = F.when(F.col("_axis"), F.coalesce("_on", F.lit(False))).otherwise(F.col("active"))
    return joined.select(*[active.alias(c) if c == "active" else F.col(c) for c in versions.columns])


def prune(rows: DataFrame, stamp: str, older_than_days: int, today: Column | None = None) -> DataFrame:
    """Rows younger than the retention period."""
    today = F.current_date() if today is None else today
    return rows.where(F.to_date(F.col(stamp)) >= F.date_sub(today, older_than_days))


def row_text(rows: DataFrame) -> Column:
    """A row as fixed text: ``name=value`` in order of names, doubles to six decimals, nothing for null."""
    parts = []
    for f in sorted(rows.schema.fields, key=lambda f: f.name):
        c = named(f.name)
        text = F.format_string("%.6f", c.cast("double")) if f.dataType.typeName() in ("double", "float", "decimal") else c.cast("string")
        parts.append(F.concat(F.lit(f"{f.name}="), F.coalesce(F.when(c.isNotNull(), text), F.lit(""))))
    return F.concat_ws("|", *parts)


def data_hash(rows: DataFrame) -> DataFrame:
    """Order-free fingerprint of a training set: hash of each row, combined by addition.

    Sums of 28-bit digit groups stay exact in a long; the row count is part of the result.
    """
    digest = rows.select(F.sha2(row_text(rows), 256).alias("_h"))
    groups = [F.conv(F.substring("_h", 1 + 7 * i, 7), 16, 10).cast("bigint") for i in range(9)]
    sums = digest.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(g).alias(f"_s{i}") for i, g in enumerate(groups)])
    joined = F.concat_ws("-", "rows", *[F.coalesce(F.col(f"_s{i}"), F.lit(0)) for i in range(9)])
    return sums.select("rows", F.sha2(joined, 256).alias("training_data_hash"))


def feedback_stats(predictions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Share of correct predictions per model version and rank."""
    judged = predictions.select(F.col("id").alias("prediction_id"), "model_version_id", "rank").join(
        feedback.select("prediction_id", "was_correct"), "prediction_id"
    )
    return judged.groupBy("model_version_id", "rank").agg(
        F.count(F.lit(1)).alias("n_feedback"), F.count_if("was_correct").alias("n_correct"),
        F.avg(F.col("was_correct").cast("int")).alias("hit_rate"),
    )


def chain_parents(nodes: DataFrame) -> DataFrame:
    """Set ``parent_id`` to the node one level up in the same project and branch."""
    linked = previous_in_series(nodes.drop("parent_id"), ["projet_id", "branche_m"], ["niveau", "id"], "id", "parent_id")
    return linked.select(*nodes.columns)


def list_defects(defects: DataFrame, limit: int | None = None, line: str | None = None) -> DataFrame:
    """Reported defects, newest first, optionally of one line or so many."""
    rows = defects if line is None else defects.where(F.col("ligne") == line)
    newest = rows.orderBy(F.desc("timestamp"), F.desc("id"))
    return newest if limit is None else newest.limit(limit)


def predictions_of(predictions: DataFrame, defects: DataFrame) -> DataFrame:
    """Stored predictions of a batch of defects, by axis and rank."""
    wanted = defects.select(F.col("id").alias("defaut_id")).distinct()
    return predictions.join(wanted, "defaut_id", "left_semi").orderBy("defaut_id", "m_axis", "rank", "id")


def model_versions(versions: DataFrame, axis: str | None = None) -> DataFrame:
    """Registered model versions, newest first."""
    rows = versions if axis is None else versions.where(F.col("m_axis") == axis)
    return rows.orderBy(F.desc("training_date"), F.desc("id"))
