"""Sheet stocks, layers, readiness, users and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutledger.operators.scan import Running, any_of, error_list, id_block, running, top_one

SILENT_MM = 2.0
CONSENT_MM = 15.0
FEEDBACK_TYPES = ["suggestion", "bug", "other"]
# Fixed value: the mail address pattern of the HTML standard.
EMAIL = r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$"


def consumption_rank(stocks: DataFrame) -> DataFrame:
    """Gapless rank per project: finite stocks first by sort order, unlimited ones last."""
    unlimited = F.col("quantity").isNull()
    fine = F.struct(unlimited.alias("u"), F.col("sort_order").alias("s"), id_block(F.col("id")).alias("i"))
    coarse = F.struct(unlimited.alias("u"), F.floor(F.col("sort_order") / 1024).alias("s"))
    return running(
        stocks,
        ["project_id"],
        [unlimited, F.col("sort_order"), F.col("id")],
        [fine, coarse],
        [Running("consumption_rank", "sum", F.lit(1), False)],
    )


def finite_then_unlimited(stocks: DataFrame) -> DataFrame:
    """All stocks in consumption order."""
    return stocks.orderBy("project_id", F.col("quantity").isNull(), "sort_order", "id")


def stock_violations(stocks: DataFrame) -> DataFrame:
    """Projects with more than one unlimited stock, or whose unlimited stock is not the last."""
    unlimited = F.col("quantity").isNull()
    facts = stocks.groupBy("project_id").agg(
        F.count("*").alias("n_stocks"),
        F.count_if(unlimited).alias("n_unlimited"),
        F.max("sort_order").alias("_last"),
        F.max(F.when(unlimited, F.col("sort_order"))).alias("_unlimited_order"),
    )
    violation = F.when(F.col("n_unlimited") > 1, "multiple_unlimited").when(
        (F.col("n_unlimited") == 1) & (F.col("_unlimited_order") != F.col("_last")), "unlimited_not_last"
    )
    return facts.withColumn("violation", violation).where("violation is not null").drop("_last", "_unlimited_order")


def keep_one_stock(stocks: DataFrame, keep_id: int | None = None) -> DataFrame:
    """One stock per project: the given id where present, else the first by sort order."""
    if keep_id is not None:
        holder = stocks.where(F.col("id") == keep_id)
        others = stocks.join(holder.select("project_id").distinct(), "project_id", "left_anti")
        return keep_one_stock(others).unionByName(holder, allowMissingColumns=True)
    return top_one(stocks, ["project_id"], [F.col("sort_order"), F.col("id")], lowest=True).select(stocks.columns)


def expand_bins(stocks: DataFrame, needed: DataFrame) -> DataFrame:
    """One row per available sheet; an unlimited stock gives as many as ``needed`` says per project."""
    copies = F.coalesce("quantity", "bins_needed", F.lit(0))
    return (
        stocks.join(needed, "project_id", "left")
        .where(copies > 0)
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
        .drop("bins_needed")
    )


def without_drafts(proposals: DataFrame, resolutions: DataFrame, projects: DataFrame) -> DataFrame:
    """Proposals without the drafts of the given projects."""
    doomed = resolutions.join(projects.select(F.col("id").alias("project_id")).distinct(), "project_id", "left_semi")
    drafts = (
        proposals.where("status = 'draft'")
        .select(F.col("id").alias("_id"), "orphan_resolution_id")
        .join(doomed.select(F.col("id").alias("orphan_resolution_id")), "orphan_resolution_id", "left_semi")
    )
    return proposals.join(drafts.select(F.col("_id").alias("id")), "id", "left_anti")


def stale_rows(current: DataFrame, kept_keys: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was not submitted; a NULL key is stale."""
    return current.join(kept_keys.select(*keys), keys, "left_anti")


def key_difference(current: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys in ``current`` that are not kept."""
    return stale_rows(current.select(*keys).distinct(), kept, keys)


def project_snapshot(projects: DataFrame, stocks: DataFrame, layers: DataFrame) -> DataFrame:
    """Project metadata as rows: one per project with the layer count, one per stock, one per included layer name.

    Rows instead of nested arrays, so that a project of any size stays spread over tasks.
    """
    counts = layers.groupBy("project_id").agg(F.count("*").alias("layers_count"))
    head = projects.select(F.col("id").alias("project_id")).join(counts, "project_id", "left").select(
        "project_id", F.lit("project").alias("part"), F.coalesce("layers_count", F.lit(0)).alias("layers_count")
    )
    sheet_rows = stocks.select("project_id", F.lit("stock").alias("part"), "width_mm", "height_mm", "quantity", "sort_order")
    names = layers.where("included").select("project_id", F.lit("layer").alias("part"), "layer_name").distinct()
    out = head.unionByName(sheet_rows, allowMissingColumns=True).unionByName(names, allowMissingColumns=True)
    return out.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi")


def primary_layer(layers: DataFrame, layer_events: DataFrame) -> DataFrame:
    """Apply "make primary" events: the last one per file wins, its siblings lose a primary role."""
    wins = top_one(
        layer_events.where("attachment_id is not null").select("project_id", "attachment_id", "layer_id", "set_at"),
        ["project_id", "attachment_id"],
        [F.col("set_at"), F.col("layer_id")],
    ).select("project_id", "attachment_id", F.col("layer_id").alias("_winner"))
    chosen = F.col("_winner") == F.col("id")
    role = (
        F.when(chosen, F.lit("primary"))
        .when(F.col("_winner").isNotNull() & (F.col("layer_role") == "primary"), F.lit(None))
        .otherwise(F.col("layer_role"))
    )
    return (
        layers.join(wins, ["project_id", "attachment_id"], "left")
        .withColumns({"layer_role": role, "included": F.col("included") | F.coalesce(chosen, F.lit(False))})
        .drop("_winner")
        .select(layers.columns)
    )


def gap_layers(layers: DataFrame) -> DataFrame:
    """Layers whose contours must be closed: primary ones, and included ones without a role."""
    return layers.where("layer_role = 'primary' or (layer_role is null and included)")


def counting_layers(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Layers whose pieces count per file: included primaries if there are any, else all included."""
    included = layers.where("included")
    mains = included.where("layer_role = 'primary'").select(*keys).distinct()
    others = included.where("layer_role is null or layer_role <> 'primary'")
    return included.where("layer_role = 'primary'").unionByName(
        others.join(mains, keys, "left_anti").select(included.columns)
    )


def missing_primary(layers: DataFrame) -> DataFrame:
    """Files with an included auxiliary layer but no included primary."""
    facts = layers.where("included and attachment_id is not null").groupBy("project_id", "attachment_id").agg(
        F.bool_or(F.coalesce(F.col("layer_role") == "auxiliary", F.lit(False))).alias("_aux"),
        F.bool_or(F.coalesce(F.col("layer_role") == "primary", F.lit(False))).alias("_main"),
    )
    return facts.where("_aux and not _main").select("project_id", "attachment_id")


def gap_class(distance: Column) -> Column:
    """Silent up to 2 mm, consent up to 15 mm, ignored beyond."""
    return F.when(distance <= SILENT_MM, "silent").when(distance <= CONSENT_MM, "consent").otherwise("ignored")


def gap_report(layers: DataFrame) -> DataFrame:
    """Gap facts per layer from its gap array."""
    gaps = F.transform("gaps_detected", lambda g: g["distance_mm"])
    warn = F.filter(gaps, lambda x: (x > SILENT_MM) & (x <= CONSENT_MM))
    return layers.withColumns(
        {
            "warnable": F.size(warn) > 0,
            "ignored": F.exists(gaps, lambda x: x > CONSENT_MM),
            "max_warnable_mm": F.array_max(warn),
            "auto_closeable": F.forall(gaps, lambda x: x <= CONSENT_MM),
            "unresolved": (F.size(warn) > 0) & ~F.coalesce("auto_close_gaps", F.lit(False)),
        }
    )


def auto_close(layers: DataFrame) -> DataFrame:
    """Closing segments: silent gaps always, wider ones up to 15 mm with consent."""
    gaps = layers.select("id", "project_id", "auto_close_gaps", F.posexplode("gaps_detected").alias("gap_no", "gap"))
    kind = gap_class(F.col("gap.distance_mm"))
    return (
        gaps.withColumn("gap_class", kind)
        .where((F.col("gap_class") == "silent") | ((F.col("gap_class") == "consent") & F.col("auto_close_gaps")))
        .select(
            F.col("id").alias("layer_id"),
            "gap_no",
            "gap_class",
            F.col("gap.distance_mm").alias("distance_mm"),
            F.array("gap.start", "gap.end").alias("segment"),
        )
    )


def readiness(projects: DataFrame, stocks: DataFrame, layers: DataFrame, layer_pieces: DataFrame) -> DataFrame:
    """Reasons a project cannot be laid out yet; ``layer_pieces`` has layer_id and n_pieces.

    Pieces count on the counting layers of each file, or of the whole project where no layer names a file.
    """
    has_stock = stocks.groupBy("project_id").agg(F.lit(True).alias("_stock"))
    facts = layers.groupBy("project_id").agg(
        F.bool_or("included").alias("_selected"), F.count("attachment_id").alias("_filed")
    )
    gaps = gap_report(gap_layers(layers)).groupBy("project_id").agg(F.bool_or("unresolved").alias("_gaps"))
    primary = missing_primary(layers).groupBy("project_id").agg(F.count("*").alias("files_without_primary"))
    per_file = layers.join(facts.select("project_id", "_filed"), "project_id").where(
        "_filed = 0 or attachment_id is not null"
    )
    counted = counting_layers(per_file.withColumn("_file", F.coalesce("attachment_id", F.lit(-1))), ["project_id", "_file"])
    pieces = (
        counted.select("project_id", F.col("id").alias("layer_id"))
        .join(layer_pieces, "layer_id")
        .groupBy("project_id")
        .agg(F.sum("n_pieces").alias("_pieces"))
    )
    no = F.lit(False)
    selected = F.coalesce("_selected", no)
    zero = F.lit(0).cast("bigint")
    return (
        projects.select(F.col("id").alias("project_id"))
        .join(has_stock, "project_id", "left")
        .join(facts, "project_id", "left")
        .join(gaps, "project_id", "left")
        .join(primary, "project_id", "left")
        .join(pieces, "project_id", "left")
        .select(
            "project_id",
            F.coalesce("files_without_primary", zero).alias("files_without_primary"),
            error_list(
                [
                    (F.col("_stock").isNull(), "no_sheet_stocks"),
                    (~selected, "no_layers_selected"),
                    (F.coalesce("files_without_primary", zero) > 0, "primary_layer_required"),
                    (selected & (F.coalesce("_pieces", zero) == 0), "no_extractable_pieces"),
                    (selected & F.coalesce("_gaps", no), "unresolved_gaps"),
                ]
            ).alias("errors"),
        )
    )


def search_users(users: DataFrame, q: str | None) -> DataFrame:
    """Users whose email or name contains the text, by email."""
    term = (q or "").strip().lower()
    if term:
        users = users.where(any_of([F.contains(F.lower(c), F.lit(term)) for c in ("email", "name")]))
    return users.orderBy("email")


def filter_feedback(feedback: DataFrame, status: str | None = None, feedback_type: str | None = None) -> DataFrame:
    """Feedback by status and type, newest first."""
    if status:
        feedback = feedback.where(F.col("status") == status)
    if feedback_type:
        feedback = feedback.where(F.col("feedback_type") == feedback_type)
    return feedback.orderBy(F.desc("created_at"), F.desc("id"))


def validate_feedback(feedback: DataFrame) -> DataFrame:
    """Normalised email and message, with the names of the failed checks."""
    email = F.nullif(F.lower(F.trim("email")), F.lit(""))
    message = F.trim("message")
    clean = feedback.withColumns({"email": F.when(F.col("user_id").isNull(), email), "message": message})
    rules = [
        (~F.coalesce(F.col("feedback_type").isin(FEEDBACK_TYPES), F.lit(False)), "feedback_type"),
        (F.coalesce(F.length("message"), F.lit(0)) < 5, "message_too_short"),
        (F.length("message") > 5000, "message_too_long"),
        (F.col("user_id").isNull() & F.col("email").isNull(), "email_required"),
        (~F.col("email").rlike(EMAIL), "email_format"),
    ]
    return clean.withColumn("errors", error_list(rules))


def orphan_blobs(blobs: DataFrame, attachments: DataFrame) -> DataFrame:
    """Stored files no attachment points at."""
    return blobs.join(attachments.select(F.col("blob_id").alias("id")), "id", "left_anti")


def either(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows in one scope or the other (NULL counts as not in scope)."""
    return df.where(F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))


def distinct_parents(derived: DataFrame) -> DataFrame:
    """Mother pieces that have derived pieces."""
    return derived.select("project_id", "parent_piece_key").distinct()
