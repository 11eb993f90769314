"""Append-only versions: what is current is a function of the log, never an update."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current_extractions(extractions: DataFrame) -> DataFrame:
    """The newest successful, non-trial extraction of each document.

    A grouped maximum with partial aggregation: one row a document is shuffled per task,
    where a window would shuffle and sort every version.
    """
    good = extractions.where("not is_trial and raw_json is not null")
    newest = F.max_by(F.struct(*good.columns), F.struct("created_at", "id")).alias("r")
    return good.groupBy("document_id").agg(newest).select("r.*")


def attempts(extractions: DataFrame) -> DataFrame:
    """Numbers attempts per document, trials apart from the rest."""
    w = Window.partitionBy("document_id", "is_trial").orderBy("created_at", "id")
    return extractions.select("id", "document_id", "is_trial", F.row_number().over(w).cast("long").alias("attempt"))


def next_attempt(extractions: DataFrame) -> DataFrame:
    return extractions.groupBy("document_id", "is_trial").agg((F.count("*") + 1).alias("next_attempt"))


def next_version(document_types: DataFrame) -> DataFrame:
    return document_types.groupBy("name").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def latest_published(document_types: DataFrame) -> DataFrame:
    return document_types.groupBy("name").agg(F.max(F.when(F.col("is_published"), F.col("version"))).alias("latest_published"))


def active_types(document_types: DataFrame) -> DataFrame:
    return document_types.where("is_active and is_published")


def overactive(document_types: DataFrame) -> DataFrame:
    """Names with more than one active version: always empty in a sound log."""
    return document_types.groupBy("name").agg(F.count_if("is_active").alias("active")).where("active > 1")


def add_version(document_types: DataFrame, new: DataFrame) -> DataFrame:
    """Appends ``new(name, display_name, is_published, is_active, created_by, id)``; an active newcomer demotes its elders.

    Raises nothing: a newcomer that is active but unpublished is refused and dropped.
    """
    new = new.where("is_published or not is_active")
    numbered = new.join(next_version(document_types), "name", "left").withColumn("version", F.coalesce("next_version", F.lit(1)).cast("long")).select(*document_types.columns)
    takes = numbered.where("is_active").select("name").distinct().withColumn("__taken", F.lit(True))
    old = document_types.join(takes, "name", "left").withColumn("is_active", F.col("is_active") & F.col("__taken").isNull()).select(*document_types.columns)
    return old.unionByName(numbered)


def failed_attempts(extractions: DataFrame, failures: DataFrame) -> DataFrame:
    """Rows to append for billed calls that gave nothing usable: counted for cost and attempts, never current.

    ``failures(id, document_id, doc_type, reason, model_used, input_tokens, output_tokens,
    cache_read_tokens, cost_usd, latency_ms, created_at)``; attempts go on from the
    document's non-trial ones, in order of time.
    """
    highest = extractions.where("not is_trial").groupBy("document_id").agg(F.count("*").alias("before"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("created_at", "id"))
    numbered = failures.withColumn("place", place).join(highest, "document_id", "left")
    return numbered.select(
        "id", "document_id", "doc_type", (F.coalesce("before", F.lit(0)) + F.col("place")).alias("attempt"), "model_used", F.lit(None).cast("string").alias("raw_json"),
        F.array(F.concat(F.lit("failed: "), F.col("reason"))).alias("validation_errors"), F.lit(False).alias("is_current"), F.lit(False).alias("is_trial"),
        "input_tokens", "output_tokens", "cache_read_tokens", "cost_usd", "latency_ms", "created_at",
    )


def drafts(document_types: DataFrame, requests: DataFrame) -> DataFrame:
    """What becomes of ``requests(name, based_on)`` for a new draft: its version, or why there is none.

    A new processor names no base; a draft of a known one starts from a published version.
    """
    known = document_types.groupBy("name").agg(F.max("version").alias("newest"), F.max(F.when(F.col("is_published"), F.col("version"))).alias("latest"))
    base = document_types.select("name", F.col("version").alias("based_on"), F.col("is_published").alias("base_published"))
    both = requests.join(known, "name", "left").join(base, ["name", "based_on"], "left")
    start = F.col("based_on").isNull()
    refusal = (
        F.when(start & F.col("latest").isNotNull(), F.concat(F.col("name"), F.lit(" already exists; start the draft from v"), F.col("latest").cast("string")))
        .when(~start & F.col("base_published").isNull(), F.concat(F.col("name"), F.lit(" has no v"), F.col("based_on").cast("string")))
        .when(~start & ~F.col("base_published"), F.concat(F.lit("v"), F.col("based_on").cast("string"), F.lit(" is a draft; start from a published version instead")))
    )
    return both.select("name", "based_on", refusal.alias("refusal"), F.when(refusal.isNull(), F.coalesce("newest", F.lit(0)) + 1).cast("long").alias("version"))


def publish(document_types: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(types after, decisions) of ``requests(name, version, based_on, failures)``, at most one a name.

    A draft is published if nobody published since it was started and its transform passes
    its examples (``failures`` is empty); the version active before is demoted with it.
    """
    latest = latest_published(document_types)
    here = document_types.select("name", "version", F.col("is_published").alias("already"))
    both = requests.join(here, ["name", "version"], "left").join(latest, "name", "left")
    title = F.concat(F.col("name"), F.lit(" v"), F.col("version").cast("string"))
    started = F.coalesce(F.concat(F.lit("v"), F.col("based_on").cast("string")), F.lit("nothing"))
    newest = F.col("latest_published").cast("string")
    conflict = F.concat(F.col("name"), F.lit(" v"), newest, F.lit(" was published after this draft was started from "), started, F.lit("; merge its changes into a new draft from v"), newest)
    refusal = (
        F.when(F.col("already").isNull(), F.concat(title, F.lit(" does not exist")))
        .when(F.col("already"), F.concat(title, F.lit(" is already published")))
        .when(~F.col("latest_published").eqNullSafe(F.col("based_on")), conflict)
        .when(F.size("failures") > 0, F.lit("the transform fails its examples"))
    )
    decisions = both.select("name", "version", refusal.alias("refusal"))
    wins = decisions.where("refusal is null").select("name", F.col("version").alias("wins_"))
    after = document_types.join(wins, "name", "left")
    now = F.col("version") == F.col("wins_")
    after = after.withColumns({"is_published": F.coalesce(now, F.lit(False)) | F.col("is_published"), "is_active": F.coalesce(now, F.col("is_active"))})
    return after.select(*document_types.columns), decisions


def retire(document_types: DataFrame, names: DataFrame) -> DataFrame:
    """Types after no document is routed to ``names(name)`` any more; versions and what they made stay."""
    gone = names.distinct().withColumn("gone_", F.lit(True))
    return document_types.join(gone, "name", "left").withColumn("is_active", F.col("is_active") & F.col("gone_").isNull()).select(*document_types.columns)


def history(document_types: DataFrame, name: str) -> DataFrame:
    return document_types.where(F.col("name") == name).orderBy(F.desc("version"))


def processor_summaries(document_types: DataFrame, access: DataFrame) -> DataFrame:
    """One row a name: versions, active and newest published version, drafts, grants, newest display name."""
    grants = access.groupBy(F.col("processor_name").alias("name")).agg(F.count("*").alias("grants"))
    out = document_types.groupBy("name").agg(
        F.count("*").alias("versions"),
        F.max(F.when(F.col("is_active"), F.col("version"))).alias("active_version"),
        F.max(F.when(F.col("is_published"), F.col("version"))).alias("published_version"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("is_published"), F.col("version")))).cast("array<string>"), ",").alias("drafts"),
        F.max_by("display_name", "version").alias("display_name"),
    )
    return out.join(grants, "name", "left").withColumn("grants", F.coalesce("grants", F.lit(0)))


def candidates(document_types: DataFrame, processors: DataFrame, access: DataFrame, organisation_id: str | None) -> DataFrame:
    """Active, published types that an organisation may use; dedicated says that it was granted rather than open to all."""
    open_ = active_types(document_types).join(processors, "name")
    granted = access.where(F.col("organisation_id") == organisation_id).select(F.col("processor_name").alias("name")).distinct().withColumn("__granted", F.lit(True))
    out = open_.join(granted, "name", "left")
    if organisation_id is not None:
        out = out.where(F.col("available_to_all") | F.col("__granted").isNotNull())
    dedicated = F.lit(organisation_id is not None) & ~F.col("available_to_all")
    return out.select("name", "version", "display_name", dedicated.alias("dedicated")).orderBy("name")


def granted_only(document_types: DataFrame, access: DataFrame, organisation_id: str) -> DataFrame:
    """Names with a grant: a left semi join."""
    grants = access.where(F.col("organisation_id") == organisation_id).select(F.col("processor_name").alias("name"))
    return document_types.select("name").distinct().join(grants, "name", "left_semi")


def organisations_with_access(access: DataFrame, organisations: DataFrame, name: str) -> DataFrame:
    return organisations.join(access.where(F.col("processor_name") == name).select(F.col("organisation_id").alias("id")), "id").orderBy("name")


def grant_changes(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """(organisation_id, change): what to add and what to remove; the rest stays untouched."""
    add = wanted.select("organisation_id").distinct().join(current, "organisation_id", "left_anti").select("organisation_id", F.lit("add").alias("change"))
    drop = current.select("organisation_id").distinct().join(wanted, "organisation_id", "left_anti").select("organisation_id", F.lit("remove").alias("change"))
    return add.unionByName(drop)


def unknown_organisations(wanted: DataFrame, organisations: DataFrame) -> DataFrame:
    return wanted.select("organisation_id").distinct().join(organisations.select(F.col("id").alias("organisation_id")), "organisation_id", "left_anti")


def current_transactions(transactions: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """The newest ledger row of each document, unless its row was withdrawn since.

    ``withdrawn(document_id, at)`` is the log of withdrawals.
    """
    newest = transactions.groupBy("document_id").agg(F.max_by(F.struct(*transactions.columns), F.struct("created_at", "transaction_id")).alias("r")).select("r.*")
    if withdrawn is None:
        return newest
    last = withdrawn.groupBy("document_id").agg(F.max("at").alias("__at"))
    return newest.join(last, "document_id", "left").where(F.col("__at").isNull() | (F.col("__at") < F.col("created_at"))).select(*transactions.columns)


def seeds_to_add(seeds: DataFrame, document_types: DataFrame) -> DataFrame:
    """Shipped definitions that the store does not know by name yet."""
    return seeds.join(document_types.select("name").distinct(), "name", "left_anti")
