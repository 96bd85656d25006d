"""Items of maps, networks and catalogues: JSON to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.ident import domain
from tessera.functions.text import page_name

ELEMENTS = (
    "remark string, elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
)

#: A response in the source's form, with made-up contents.
EXAMPLE = """{"elements": [
{"type": "node", "id": 1, "lat": 37.4, "lon": -5.9, "tags": {"name": " ", "brand": "Uno", "addr:street": "Mayor", "addr:housenumber": "3", "phone": "600000001; 600000002", "website": "https://uno.example"}},
{"type": "way", "id": 2, "center": {"lat": 37.5, "lon": -5.8}, "tags": {"operator": "Dos", "contact:email": "a@dos.example"}},
{"type": "node", "id": 3, "lat": 37.0, "lon": -5.0, "tags": {"craft": "builder"}}]}"""


def _text(c: Column) -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(F.trim(c), F.lit(""))


def _parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def map_elements(responses: DataFrame, json: str = "json") -> DataFrame:
    """Records of the named elements. A response that isn't JSON, or reports an error, fails; it is never 'no rows'."""
    parsed = responses.select(F.col(json).alias("raw"), F.from_json(json, ELEMENTS, {"mode": "PERMISSIVE"}).alias("r"))
    sound = F.ltrim("raw").startswith("{") & ~F.coalesce(F.lower("r.remark").contains("error"), F.lit(False))
    # the check is part of the value that is used, so that it can't be pruned away
    problem = F.when(sound, F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("bad map response: "), F.substring("raw", 1, 200))))
    checked = parsed.select(F.when(problem.isNull(), F.col("r.elements")).alias("elements"))
    e = checked.select(F.explode("elements").alias("e"))
    tag = lambda *names: F.coalesce(*[_text(F.col("e.tags")[n]) for n in names])
    street, number = tag("addr:street"), tag("addr:housenumber")
    out = e.select(
        F.concat("e.type", F.lit("/"), "e.id").alias("external_id"),
        tag("name", "brand", "operator").alias("name"),
        F.when(number.isNotNull(), F.concat(street, F.lit(" "), number)).otherwise(street).alias("address"),
        tag("addr:postcode").alias("postal_code"),
        tag("addr:city").alias("municipality"),
        tag("addr:province").alias("province"),
        F.coalesce("e.lat", "e.center.lat").alias("lat"),
        F.coalesce("e.lon", "e.center.lon").alias("lon"),
        _parts(tag("phone", "contact:phone", "contact:mobile", "mobile")).alias("phones"),
        _parts(tag("email", "contact:email")).alias("emails"),
        tag("website", "contact:website", "url").alias("web"),
    )
    return out.where("name is not null")


def place_items(rows: DataFrame, json: str = "json") -> DataFrame:
    """Records of places: closed, nameless and contactless ones are left out."""
    schema = "title string, permanentlyClosed boolean, phone string, website string, location struct<lat:double,lng:double>, placeId string, address string, url string, categoryName string"
    i = rows.select(F.from_json(json, schema).alias("i")).select("i.*")
    kept = i.where(~F.coalesce("permanentlyClosed", F.lit(False)) & (_text(F.col("title")).isNotNull()) & (_text(F.col("phone")).isNotNull() | _text(F.col("website")).isNotNull()))
    return kept.select(
        F.col("placeId").alias("external_id"), page_name(F.trim("title")).alias("name"), _text(F.col("address")).alias("address"), F.col("location.lat").alias("lat"), F.col("location.lng").alias("lon"),
        F.array_compact(F.array(_text(F.col("phone")))).alias("phones"), _text(F.col("website")).alias("web"), F.col("categoryName").alias("category"),
    )


def network_items(rows: DataFrame, json: str = "json") -> DataFrame:
    """Records of company pages of a professional network. The size is the one that the company states, never a member count."""
    schema = "name string, website string, street string, headquarters string, postalCode string, city string, state string, companySize string, linkedinUrl string, industry string"
    i = rows.select(F.from_json(json, schema).alias("i")).select("i.*").where(_text(F.col("name")).isNotNull())
    return i.select(
        F.col("linkedinUrl").alias("external_id"), F.trim("name").alias("name"), F.coalesce(_text(F.col("street")), _text(F.col("headquarters"))).alias("address"), _text(F.col("postalCode")).alias("postal_code"),
        _text(F.col("city")).alias("municipality"), _text(F.col("state")).alias("province"), _text(F.col("website")).alias("web"), _text(F.col("companySize")).alias("employees"), F.col("industry"),
    )


def page_items(rows: DataFrame, json: str = "json") -> DataFrame:
    """Records of social pages; the address is kept whole."""
    schema = "title string, pageName string, phone string, email string, websites array<string>, website string, address string, pageId string, facebookId string, facebookUrl string, pageUrl string"
    i = rows.select(F.from_json(json, schema).alias("i")).select("i.*")
    name = F.coalesce(_text(F.col("title")), _text(F.col("pageName")))
    return i.where(name.isNotNull()).select(
        F.coalesce("pageId", "facebookId").alias("external_id"), page_name(name).alias("name"), _text(F.col("address")).alias("address"), F.array_compact(F.array(_text(F.col("phone")))).alias("phones"),
        F.array_compact(F.array(_text(F.col("email")))).alias("emails"), _text(F.coalesce(F.get("websites", 0), "website")).alias("web"), F.coalesce("facebookUrl", "pageUrl").alias("url"),
    )


def one_or_many(json: Column, schema: str) -> Column:
    """An array of structs from JSON that holds an object or a list of them."""
    return F.when(F.ltrim(json).startswith("["), F.from_json(json, f"array<struct<{schema}>>")).otherwise(F.array(F.from_json(json, f"struct<{schema}>")))


def texts_by_domain(pages: DataFrame, url: str = "url", text: str = "text") -> DataFrame:
    """(domain, texts): the texts of each site's pages in order of URL. Pages of a site fit one row."""
    rows = pages.select(domain(F.col(url)).alias("domain"), F.struct(F.col(url).alias("url"), F.col(text).alias("text")).alias("p")).where("domain is not null")
    return rows.groupBy("domain").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["text"]).alias("texts"))


def code_hierarchy(sheet: DataFrame, order: str = "row", code: str = "code") -> DataFrame:
    """(code, level, parent) of an ordered catalogue sheet: sections are letters and are carried forward to divisions.

    A catalogue has a thousand rows, so one ordered window over all is right.
    """
    plain = F.replace(F.trim(F.col(code)), F.lit("."), F.lit(""))
    rows = sheet.select(order, F.when(plain.rlike("^[0-9]$"), F.concat(F.lit("0"), plain)).otherwise(plain).alias("code"))
    rows = rows.groupBy("code").agg(F.min(order).alias(order)).where("code <> ''")
    level = F.when(F.col("code").rlike("^[0-9]+$"), F.length("code")).otherwise(1)
    section = F.last(F.when(level == 1, F.col("code")), ignorenulls=True).over(W.orderBy(order))
    parent = F.when(level == 2, section).when(level > 2, F.substring("code", F.lit(1), level - 1))
    return rows.select("code", level.alias("level"), parent.alias("parent"))


def latest_of_series(series: DataFrame, json: str = "json") -> DataFrame:
    """(name, year, value): the last datum of each statistics series that has one."""
    s = series.select(F.from_json(json, "Nombre string, Data array<struct<Anyo:int,Valor:double>>").alias("s"))
    last = F.try_element_at("s.Data", F.lit(-1))
    return s.select(F.col("s.Nombre").alias("name"), last["Anyo"].alias("year"), last["Valor"].cast("long").alias("value")).where("year is not null and value is not null")


def orphan_codes(facts: DataFrame, catalogue: DataFrame, code: str = "code") -> DataFrame:
    """Codes of facts that the catalogue doesn't know; a load requires none."""
    return facts.select(code).distinct().join(catalogue.select(code), code, "left_anti")


def csv_catalogue(spark, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")
