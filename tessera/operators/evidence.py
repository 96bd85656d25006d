"""Evidence: observations of fields consolidated into values with a confidence.

An observation is one row (entity, field, value, source_group, confidence,
observed_at, official). Within a group of dependent sources only the strongest
counts; independent groups combine as 1 - prod(1 - c); the result halves with
each half-life of the field since the last observation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Half-lives in days (other fields don't decay), thresholds and weights.
HALF_LIFE_DAYS = {"estado": 180, "sede_operativa": 540, "telefono": 365, "email": 365, "web": 90, "tamano": 365, "empleados": 365}
OFFICIAL_FIRST = ["razon_social", "domicilio_social", "direccion"]
SINGLE_VALUE = ["nif", "razon_social", "web"]
KEEP_OVER = 0.5
CONFLICT_OVER = 0.7
CONFLICT_FACTOR = 0.7
ALTERNATIVE_FROM = 0.35
OLD_DAYS = 30
CLEAR_MARGIN = 0.30
GLOBAL_WEIGHTS = {"identity": 0.40, "state": 0.25, "location": 0.15, "contact": 0.20}
CAP_WITHOUT_NIF = 0.6
DEAD_STATES = ["extinguida", "disuelta", "inactiva", "en_liquidacion", "en_concurso"]

ENTITY = ["entity", "field"]


def elapsed_days(since: Column, as_of: Column) -> Column:
    """Whole blocks of 24 hours, at least 0."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(micros / F.lit(86_400_000_000.0))).cast("int")


def half_life(field: Column, days: dict[str, int] = HALF_LIFE_DAYS) -> Column:
    out = F.lit(None).cast("int")
    for name, n in days.items():
        out = F.when(field == name, n).otherwise(out)
    return out


def consolidate(observations: DataFrame, as_of: Column, days: dict[str, int] = HALF_LIFE_DAYS) -> DataFrame:
    """One row a value of each (entity, field), best first.

    Columns: rank, confidence, effective (after decay, and after the penalty of a
    contradicted winner), age_days, n_observations, n_groups, official, last_seen,
    conflict. A penalty never changes the order. Blank values are left out.
    """
    used = observations.where("value is not null and value <> ''")
    by_group = used.groupBy(*ENTITY, "value", "source_group").agg(
        F.max(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))).alias("c"),
        F.max("observed_at").alias("seen"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.coalesce("official", F.lit(False))).alias("official"),
    )
    values = by_group.groupBy(*ENTITY, "value").agg(
        F.round(1 - F.product(1 - F.col("c")), 4).alias("confidence"),
        F.max("seen").alias("last_seen"),
        F.sum("n").alias("n_observations"),
        F.count(F.lit(1)).alias("n_groups"),
        F.max("official").alias("official"),
    )
    age = elapsed_days(F.col("last_seen"), as_of)
    life = half_life(F.col("field"), days)
    decayed = F.round(F.col("confidence") * F.pow(F.lit(0.5), age / life), 4)
    values = values.withColumn("age_days", age).withColumn("effective", F.when(life.isNull(), F.col("confidence")).otherwise(decayed))
    first = F.when(F.col("field").isin(*OFFICIAL_FIRST) & F.col("official"), 0).otherwise(1)
    order = W.partitionBy(*ENTITY).orderBy(F.desc("effective"), first, F.desc("last_seen"), "value")
    ranked = values.withColumn("rank", F.row_number().over(order)).withColumn("_next", F.lead("effective").over(order))
    conflict = F.coalesce((F.col("rank") == 1) & (F.col("_next") > CONFLICT_OVER), F.lit(False))
    return (
        ranked.withColumn("conflict", conflict)
        .withColumn("effective", F.when(conflict, F.round(F.col("effective") * CONFLICT_FACTOR, 4)).otherwise(F.col("effective")))
        .drop("_next")
    )


def kept_values(consolidated: DataFrame) -> DataFrame:
    """The values of fields that may have several."""
    return consolidated.where(F.col("effective") > KEEP_OVER)


def representative(observations: DataFrame) -> DataFrame:
    """(entity, field, value, original): the original text of the strongest, then latest, observation of each value."""
    best = F.max_by("original", F.struct(F.coalesce("confidence", F.lit(0.0)), "observed_at", "original"))
    return observations.where("original is not null and original <> ''").groupBy(*ENTITY, "value").agg(best.alias("original"))


def classify_conflicts(consolidated: DataFrame, observations: DataFrame, fields: list[str] = SINGLE_VALUE) -> DataFrame:
    """(entity, field, chosen, kind, n_alternatives): contradictions of fields that have one value.

    None is open where a person decided. One is resolved if the system decided
    before, or if the winner is strongly better than every alternative; otherwise
    it is uncontrasted.
    """
    single = consolidated.where(F.col("field").isin(*fields))
    deciders = (
        observations.where(F.col("source_group").isin("manual", "verificacion_automatica"))
        .groupBy(*ENTITY, "value")
        .agg(F.max(F.col("source_group") == "manual").alias("manual"), F.max(F.col("source_group") != "manual").alias("automatic"))
    )
    columns = ["value", "confidence", "effective", "age_days", "n_groups", "official"]
    winners = single.where("rank = 1").join(deciders, [*ENTITY, "value"], "left").select(*ENTITY, "manual", "automatic", *[F.col(c).alias(f"w_{c}") for c in columns])
    others = single.where((F.col("rank") > 1) & (F.col("effective") >= ALTERNATIVE_FROM)).select(*ENTITY, *columns)
    strong = (
        ((F.col("w_n_groups") >= 2) & (F.col("n_groups") == 1))
        | ((F.col("age_days") - F.col("w_age_days") >= OLD_DAYS) & (F.col("w_confidence") >= F.col("confidence")))
        | (F.col("w_official") & ~F.col("official"))
        | (F.col("w_effective") - F.col("effective") >= CLEAR_MARGIN)
    )
    open_ones = others.join(winners.where(~F.coalesce("manual", F.lit(False))), ENTITY)
    found = open_ones.groupBy(*ENTITY).agg(
        F.first("w_value").alias("chosen"),
        F.max(F.coalesce("automatic", F.lit(False))).alias("automatic"),
        F.bool_and(strong).alias("strong"),
        F.count(F.lit(1)).alias("n_alternatives"),
    )
    kind = F.when(F.col("automatic") | F.col("strong"), "resolved").otherwise("uncontrasted")
    return found.select(*ENTITY, "chosen", kind.alias("kind"), "n_alternatives")


POSITIVE_SIGNALS = ["web_alive", "recent_award", "recent_act", "open_on_maps", "active_networks"]


def company_state(signals: dict[str, Column]) -> Column:
    """struct<state, confidence> from boolean signals (absent ones are false) and the count ``negative``.

    Hard rules come first, in order; then the balance of positive and negative signals.
    """
    flag = lambda name: F.coalesce(signals.get(name, F.lit(False)), F.lit(False))
    positive = sum((flag(n).cast("int") for n in POSITIVE_SIGNALS), F.lit(0))
    negative = F.coalesce(signals.get("negative", F.lit(0)), F.lit(0))
    row = lambda state, c: F.struct(F.lit(state).alias("state"), F.lit(c).cast("double").alias("confidence"))
    return (
        F.when(flag("extinct"), row("extinguida", 0.95))
        .when(flag("dissolved_in_liquidation"), row("en_liquidacion", 0.95))
        .when(flag("dissolved"), row("disuelta", 0.95))
        .when(flag("insolvent"), row("en_concurso", 0.90))
        .when(flag("nif_revoked"), row("inactiva", 0.90))
        .when(flag("closed_on_maps") & (positive == 0), row("inactiva", 0.85))
        .when(flag("closed_on_maps"), row("dudosa", 0.60))
        .when((positive > 0) & (negative > 0), row("dudosa", 0.55))
        .when(positive >= 2, row("activa", 0.85))
        .when(positive == 1, row("probablemente_activa", 0.65))
        .when(negative > 0, row("inactiva", 0.55))
        .otherwise(row("desconocida", 0.30))
    )


def signals_of_acts(kinds: Column) -> dict[str, Column]:
    """Signals of a registry act's kinds (array): the gravest one only."""
    has = lambda k: F.coalesce(F.array_contains(kinds, k), F.lit(False))
    extinct, dissolved, insolvent = has("extincion"), has("disolucion"), has("concurso")
    return {
        "extinct": extinct,
        "dissolved": dissolved & ~extinct,
        "insolvent": insolvent & ~dissolved & ~extinct,
        "recent_act": (has("constitucion") | has("cambio_domicilio") | has("cambio_denominacion")) & ~insolvent & ~dissolved & ~extinct,
    }


def identity_confidence(nif: Column, name: Column) -> Column:
    """Mean of those that are known; 0 if none is."""
    n = nif.isNotNull().cast("int") + name.isNotNull().cast("int")
    return F.round(F.when(n > 0, (F.coalesce(nif, F.lit(0.0)) + F.coalesce(name, F.lit(0.0))) / n).otherwise(0.0), 4)


def contact_confidence(phone: Column, mail: Column) -> Column:
    return F.coalesce(F.greatest(phone, mail), F.lit(0.0))


def global_confidence(identity: Column, state: Column, location: Column, contact: Column, nif_confirmed: Column) -> Column:
    """Weighted sum of the four sides, unknown ones as 0, capped without a confirmed tax number."""
    sides = dict(zip(GLOBAL_WEIGHTS, (identity, state, location, contact)))
    total = sum((GLOBAL_WEIGHTS[k] * F.coalesce(c, F.lit(0.0)) for k, c in sides.items()), F.lit(0.0))
    capped = F.when(F.coalesce(nif_confirmed, F.lit(False)), total).otherwise(F.least(total, F.lit(CAP_WITHOUT_NIF)))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), capped)), 4)
