"""Registered queries of merges, golden rows, names inside names, whole results and decided alternatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ident
from tessera.functions.html import html_text
from tessera.operators import alternatives, filters, matching, merging, names, results, site_records
from tessera.operators.joins import spread
from tessera.plans.queries import AS_OF, CONSOLIDATED, RANKED, _ranked, query
from tessera.plans.tables import ctes, derived, read
from tessera.storage import new_path
from tessera.streaming.golden import GoldenStore
from tessera.streaming.process import Processor, store_of

# Names


@query(
    """WITH n AS (SELECT DISTINCT p_name AS asked FROM part), h AS (SELECT DISTINCT p_type || ' ' || p_name || ' sl' AS held FROM part),
w AS (SELECT asked, unnest(string_split(asked, ' ')) AS w FROM n),
a AS (SELECT asked, list_distinct(flatten(list([substr('  ' || w || ' ', i, 3) for i in generate_series(1, length(w) + 1)]))) AS g FROM w GROUP BY 1),
l AS (SELECT held, string_split(lower(held), ' ') AS ws FROM h),
b AS (SELECT held, flatten([[substr('  ' || w || ' ', i, 3) for i in generate_series(1, length(w) + 1)] for w in ws]) AS g FROM l),
p AS (SELECT asked, held, a.g AS a, b.g AS b FROM a JOIN b ON list_has_any(a.g, b.g)),
r AS (SELECT asked, held, a, list_distinct(b[i:j]) AS run FROM (SELECT asked, held, a, b, i, unnest(generate_series(i, len(b))) AS j FROM (SELECT *, unnest(generate_series(1, len(b))) AS i FROM p)))
SELECT asked, held, max(round(len(list_intersect(a, run)) / CAST(len(a) + len(run) - len(list_intersect(a, run)) AS DOUBLE), 6)) AS similarity
FROM r GROUP BY 1, 2 HAVING max(len(list_intersect(a, run)) / CAST(len(a) + len(run) - len(list_intersect(a, run)) AS DOUBLE)) > 0.5"""
)
def names_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked names with the longer names that they are found in: all distinct names of parts, with kind and legal form around them."""
    part = read(spark, sf_dir, "part")
    asked = part.select(F.col("p_name").alias("k"), F.col("p_name").alias("n")).distinct()
    whole = F.concat_ws(" ", "p_type", "p_name", F.lit("sl"))
    held = part.select(whole.alias("k"), F.lower(whole).alias("n")).distinct()
    found = names.inside(asked, held, "k", "n")
    return found.select(F.col("l_key").alias("asked"), F.col("r_key").alias("held"), F.round("similarity", 6).alias("similarity"))


# Merges

#: Customers play companies: of each ten, those ending in 1 to 5 merge into the one before, those in 7 and 8 into that in 6.
MERGES = """CASE WHEN c_custkey % 10 BETWEEN 1 AND 5 THEN c_custkey - 1 WHEN c_custkey % 10 IN (7, 8) THEN c_custkey - c_custkey % 10 + 6 END"""


@query(
    f"""WITH RECURSIVE k AS (SELECT c_custkey AS id, {MERGES} AS winner FROM customer),
m AS (SELECT id AS loser, winner FROM k WHERE winner IN (SELECT id FROM k)),
u AS (SELECT loser, winner AS root FROM m UNION ALL SELECT u.loser, m.winner FROM u JOIN m ON m.loser = u.root),
roots AS (SELECT loser, root FROM u WHERE root NOT IN (SELECT loser FROM m)),
o AS (SELECT o_orderkey AS row, o_custkey AS company, coalesce(root, o_custkey) AS root, o_custkey % 10 AS d, o_orderpriority AS key FROM orders LEFT JOIN roots ON loser = o_custkey),
f AS (SELECT *, min(d) OVER (PARTITION BY root, key) AS first, lag(company) OVER w AS dummy FROM o WINDOW w AS (ORDER BY row)),
r AS (SELECT c.company, c.key, c.root, c.d, max(x.d) AS below FROM (SELECT DISTINCT company, key, root, d FROM f) c LEFT JOIN (SELECT DISTINCT company, key, root, d FROM f) x
      ON x.root = c.root AND x.key = c.key AND x.d < c.d GROUP BY 1, 2, 3, 4)
SELECT 'orders' AS name, row, root AS company_id FROM o
UNION ALL SELECT 'priorities', f.row, CASE WHEN f.d = f.first OR f.company = f.root THEN f.root WHEN f.d <= 5 THEN f.root + r.below + 1 ELSE f.company END
FROM f JOIN r ON r.company = f.company AND r.key = f.key
UNION ALL SELECT 'companies', id, m.winner FROM k LEFT JOIN m ON m.loser = k.id"""
)
def merged_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, row, company_id) of two child tables and of the companies' tombstones after chains and stars of merges, read from a committed version.

    Orders are children that always move. As priorities, a company holds each priority once.
    """
    customers, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    known = customers.select(F.col("c_custkey").alias("winner"))
    merges = customers.select(F.col("c_custkey").alias("loser"), F.expr(MERGES).alias("winner"), F.col("c_custkey").alias("seq")).where("winner is not null").join(known, "winner", "left_semi")
    merges = merges.select("loser", "winner", "seq", F.lit("same sheet").alias("reason"), F.lit(1.0).alias("score"), F.lit("rules").alias("decided_by"))
    companies = customers.select(F.col("c_custkey").alias("company_id"), F.lit(None).cast("long").alias("merged_into"))
    child = orders.select(F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("key"))
    tables = {"companies": companies, "orders": child, "priorities": child}
    held = merging.Versions(spark, new_path(spark, "merged"))
    held.commit(merging.merged_tables(tables, merges, {"orders": [], "priorities": ["key"]}))
    out = held.read()
    rows = [out[name].select(F.lit(name).alias("name"), "row", "company_id") for name in ("orders", "priorities")]
    dead = out["companies"].select(F.lit("companies").alias("name"), F.col("company_id").alias("row"), F.col("merged_into").alias("company_id"))
    return rows[0].unionByName(rows[1]).unionByName(dead)


# Golden rows batch by batch

SPLIT = "event_id % 10 = 3 AND user_id % 4 = 0"


@query(
    CONSOLIDATED.replace("CAST(user_id AS STRING) AS entity", f"CASE WHEN {SPLIT} THEN 'own ' || CAST(user_id AS STRING) ELSE CAST(user_id AS STRING) END AS entity").replace(
        "FROM events)",
        f"FROM events UNION ALL SELECT DISTINCT CAST(user_id AS STRING), 'web', 'chosen', 'human', 0.98, TIMESTAMP '{AS_OF}', false, 'chosen' FROM events WHERE user_id % 7 = 0)",
    )
    + """SELECT entity, max(value) FILTER (field = 'web') AS web, max(value) FILTER (field = 'razon_social') AS razon_social, count(*) AS n_fields
FROM consolidated WHERE rank = 1 GROUP BY 1"""
)
def golden_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden rows after three batches of events, one of them delivered twice, a split of records and people's choices."""
    seen = derived(spark, sf_dir, "observations").withColumn("confidence", F.col("confidence").cast("double"))
    event = F.regexp_extract("original", "([0-9]+)$", 1).cast("long")
    seen = seen.withColumn("record_id", event.cast("string")).withColumn("source", F.lit("events"))
    as_of = F.lit(AS_OF).cast("timestamp")
    held = GoldenStore(spark, new_path(spark, "golden"), ["web", "razon_social"])
    for batch in (0, 1, 2, 1):
        held.add(batch, seen.where(event % 3 == batch), as_of)
    users = read(spark, sf_dir, "events").select("event_id", "user_id")
    own = users.where(SPLIT).select(F.col("event_id").cast("string").alias("record_id"), F.concat(F.lit("own "), F.col("user_id").cast("string")).alias("new_entity"))
    held.split(3, own, as_of)
    chosen = users.where("user_id % 7 = 0").select(F.col("user_id").cast("string").alias("entity"), F.lit("web").alias("field"), F.lit("chosen").alias("value"), as_of.alias("observed_at")).distinct()
    held.decide(4, chosen, as_of)
    return held.golden()


# Whole results

_WHOLE = {
    "reason": "'por ' || segment", "verdict_reason": "CASE WHEN company_id % 3 = 0 THEN 'sector ' || segment END", "size_source": "CASE WHEN size_lo IS NOT NULL THEN 'web' END",
}


@query(
    RANKED.rstrip()
    + f"""
SELECT r.company_id, {_WHOLE['reason'].replace('segment', 'c.segment')} AS reason, r.verdict, {_WHOLE['verdict_reason'].replace('company_id', 'r.company_id').replace('segment', 'c.segment')} AS verdict_reason, r.name, r.trade_name, r.nif, c.state, r.confidence, c.domain,
  c.natural_person, r.phone, r.email, r.contact, r.role, r.uncontrasted, r.in_review, r.completeness, c.size_lo, c.size_hi, {_WHOLE['size_source'].replace('size_lo', 'c.size_lo')} AS size_source
FROM ranked r JOIN companies c ON c.company_id = r.company_id ORDER BY completeness DESC, r.confidence DESC NULLS LAST, r.company_id LIMIT 100 OFFSET 20"""
)
def whole_results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a search with all 21 columns: the page is the feature."""
    ranked = _ranked(spark, sf_dir).withColumns({name: F.expr(sql) for name, sql in _WHOLE.items()})
    return results.whole_page(ranked, 100, 20)


@query(
    RANKED
    + """SELECT count(*) AS total, count(*) FILTER (completeness = 5) AS complete, count(nif) AS with_nif, count(contact) AS with_contact, count(phone) AS with_phone, count(email) AS with_email,
  (SELECT count(*) FROM results JOIN companies USING (company_id) WHERE merged_into IS NULL AND verdict IN ('descartado', 'rechazado')) AS rejected FROM ranked"""
)
def whole_results_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven counters of a search."""
    return results.whole_summary(derived(spark, sf_dir, "results"), derived(spark, sf_dir, "companies"), _ranked(spark, sf_dir))


STORE = filters.Filters(states=["activa", "probablemente_activa", "dudosa"], needs_web=True, least_confidence=0.1)


@query(
    ctes("companies", "channels")
    + """, s AS (SELECT * FROM companies WHERE merged_into IS NULL AND state IN ('activa', 'probablemente_activa', 'dudosa') AND domain IS NOT NULL AND coalesce(confidence, 0) >= 0.1),
h AS (SELECT company_id, bool_or(kind = 'phone') AS p, bool_or(kind = 'email') AS m FROM channels WHERE state IS DISTINCT FROM 'invalid' GROUP BY 1),
t AS (SELECT company_id || ':' || coalesce(name, '') || ':' || coalesce(domain, '') AS x, row_number() OVER (ORDER BY confidence DESC NULLS LAST, company_id) AS nth FROM s)
SELECT count(*) AS n, round(avg(confidence), 3) AS confidence, round(100.0 * count(*) FILTER (p) / greatest(count(*), 1), 1) AS pct_phone, round(100.0 * count(*) FILTER (m) / greatest(count(*), 1), 1) AS pct_email,
  round(100.0 * count(domain) / greatest(count(*), 1), 1) AS pct_web, round(100.0 * count(nif) / greatest(count(*), 1), 1) AS pct_nif,
  (SELECT string_agg(x, ';' ORDER BY nth) FROM t WHERE nth <= 10) AS sample FROM s LEFT JOIN h USING (company_id)"""
)
def asked_of_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question to the store in one call: filter, figures and a sample, which is a report's."""
    c, s, h = (derived(spark, sf_dir, n) for n in ("companies", "sites", "channels"))
    seen = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderdate").alias("observed_at"))
    found = filters.search(c, STORE, s, h, seen, F.lit("1998-08-01").cast("timestamp"))
    out = results.asked_of_store(found, h)
    line = lambda x: F.concat(x["company_id"].cast("string"), F.lit(":"), F.coalesce(x["name"], F.lit("")), F.lit(":"), F.coalesce(x["domain"], F.lit("")))
    return out.withColumn("sample", F.array_join(F.transform("sample", line), ";"))


# Alternatives that a site decides


@query(
    """WITH t AS (SELECT o_orderkey AS k, o_custkey AS c, 'Aviso legal de Obras ' || o_custkey || ' y Reformas. CIF B-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || CASE WHEN o_orderkey % 5 = 0 THEN ' y A 00000001' ELSE '' END AS text FROM orders),
a AS (SELECT k, 'nif' AS field, ['b' || lpad(CAST(k AS VARCHAR), 8, '0'), 'A00000001', 'B99999999'] AS alternatives, text FROM t
      UNION ALL SELECT k, 'razon_social', ['Obras ' || c, 'Reformas Nortesur', CASE WHEN k % 3 = 0 THEN 'Aviso' ELSE '' END], text FROM t),
e AS (SELECT k, field, unnest(alternatives) AS value, text FROM a),
f AS (SELECT k, field, value FROM e WHERE value <> '' AND CASE WHEN field = 'nif' THEN contains(replace(replace(upper(text), '-', ''), ' ', ''), upper(value))
      ELSE contains(' ' || regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g') || ' ', ' ' || lower(value) || ' ') END)
SELECT k AS page, field, min(value) AS value FROM f GROUP BY 1, 2 HAVING count(*) = 1"""
)
def decided_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of made-up sites of orders that the site's text decides: exactly one alternative stands in it."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    digits = F.lpad(k.cast("string"), 8, "0")
    body = F.concat(F.lit("Aviso legal de Obras "), c, F.lit(" y Reformas. CIF B-"), digits, F.when(k % 5 == 0, " y A 00000001").otherwise(""))
    orders = read(spark, sf_dir, "orders")
    number = F.array(F.concat(F.lit("b"), digits), F.lit("A00000001"), F.lit("B99999999"))
    name = F.array(F.concat(F.lit("Obras "), c), F.lit("Reformas Nortesur"), F.when(k % 3 == 0, "Aviso").otherwise(""))
    both = F.array(F.struct(F.lit("nif").alias("field"), number.alias("alternatives")), F.struct(F.lit("razon_social").alias("field"), name.alias("alternatives")))
    conflicts = orders.select(k.alias("site"), F.explode(both).alias("x")).select("site", "x.*").withColumn("conflict_id", F.struct("site", "field"))
    found = alternatives.only_alternatives(conflicts, orders.select(k.alias("site"), body.alias("text")))
    return found.select(F.col("conflict_id.site").alias("page"), F.col("conflict_id.field").alias("field"), "value")


@query()
def alternatives_on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the words of three pages' addresses stands alone in a page's text. Tests hold it against a search word by word."""
    pages = read(spark, sf_dir, "pages")
    word = F.regexp_replace(F.element_at(F.split(F.col("url"), "/"), -1), "[^A-Za-z]+", " ")
    listed = pages.select(F.col("page_id").alias("conflict_id"), F.col("page_id").alias("site"), F.lit("razon_social").alias("field"), F.array_distinct(F.concat(F.split(word, " "), F.array(F.lit("the"), F.lit("der"), F.lit("que")))).alias("alternatives"))
    return alternatives.only_alternatives(listed, pages.select(F.col("page_id").alias("site"), html_text(F.col("html")).alias("text")))


# People and records of sites


@query(
    """WITH p AS (SELECT o_orderkey AS site, o_custkey AS c, o_orderkey % 200 AS gap FROM orders),
x AS (SELECT site, 'Ana Ruiz Gil' AS name, CASE site % 4 WHEN 0 THEN 'Gerente' WHEN 1 THEN 'Contacto' WHEN 2 THEN 'Jefa de obra' ELSE 'Directora ' || chr(10) || ' técnica' END AS role, gap FROM p
      UNION ALL SELECT site, 'Gerente Luis', 'Gerente', gap FROM p UNION ALL SELECT site, 'Eva Sol', 'Gerente', gap FROM p UNION ALL SELECT site, 'Nadie Aquí', 'Gerente', gap FROM p)
SELECT site, name, role FROM x WHERE (name = 'Ana Ruiz Gil' AND (site % 4 = 1 OR (site % 4 = 0 AND gap <= 112))) OR name = 'Eva Sol'"""
)
def told_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People that a model read on made-up pages: two people, one role, at different distances.

    A gerente stands before Eva Sol, and as far behind Ana Ruiz Gil as the page's key says.
    """
    k = F.col("o_orderkey")
    body = F.concat(F.lit("Gerente: Eva  Sol. "), F.repeat(F.lit("x"), F.lit(300)), F.lit(" Ana Ruiz\nGil "), F.repeat(F.lit("-"), (k % 200).cast("int")), F.lit("gerente"))
    orders = read(spark, sf_dir, "orders")
    role = F.when(k % 4 == 0, "Gerente").when(k % 4 == 1, "Contacto").when(k % 4 == 2, "Jefa de obra").otherwise("Directora \n técnica")
    one = lambda name, role: F.struct(F.lit(name).alias("name"), role.alias("role"))
    listed = F.array(one("Ana Ruiz Gil", role), one("Gerente Luis", F.lit("Gerente")), one("Eva Sol", F.lit("Gerente")), one("Nadie Aquí", F.lit("Gerente")))
    people = orders.select(k.alias("site"), F.explode(listed).alias("p")).select("site", "p.*")
    return site_records.told_people(orders.select(k.alias("site"), body.alias("text")), people)


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 4 AS m FROM orders), v AS (SELECT *, lpad(CAST(k % 10000000 AS VARCHAR), 7, '0') AS d FROM o),
w AS (SELECT *, (10 - (CAST(d[2] AS INT) + CAST(d[4] AS INT) + CAST(d[6] AS INT) + list_sum([CAST(d[i] AS INT) * 2 // 10 + CAST(d[i] AS INT) * 2 % 10 FOR i IN [1, 3, 5, 7]])) % 10) % 10 AS control FROM v)
SELECT k AS site, CASE WHEN m <> 1 THEN 'Obras ' || c || ' S.L' END AS name, CASE WHEN m <> 1 THEN 'B' || d || CAST(control AS VARCHAR) END AS nif, CASE WHEN m = 1 THEN 'Hosting ' || c || ' S.L' END AS dropped_name,
  '+34954123456' AS phones, CASE WHEN m = 2 THEN 'a@obras' || c || '.es' ELSE 'a@obras' || c || '.es,b@otra.es' END AS emails, 'Ana Ruiz Gil:Gerente' AS people FROM w WHERE m <> 3"""
)
def records_of_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of made-up sites: companies, a provider of sites, and public bodies, which give none."""
    k, c, m = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.col("o_orderkey") % 4
    d = F.lpad((k % 10_000_000).cast("string"), 7, "0")
    name = F.when(m == 1, F.concat(F.lit("Hosting "), c)).when(m == 3, F.concat(F.lit("Consorcio "), c)).otherwise(F.concat(F.lit("Obras "), c))
    body = F.concat(
        F.lit("Titular: "), name, F.lit(" S.L., sociedad\nCIF: B-"), d, ident.company_control(d), F.lit("\nTel. 954 12 34 56, +33 1 23 45 67 89\nEmail: a@obras"), c,
        F.lit(".es b@otra.es\nGerente: Ana Ruiz Gil\n"),
    )
    sites = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select(k.alias("site"), body.alias("text"), F.when(m == 2, F.concat(F.lit("obras"), c, F.lit(".es"))).alias("domain"))
    told = sites.select("site", F.lit("ANA RUIZ GIL").alias("name"), F.lit("Gerente").alias("role"))
    found = site_records.site_records(sites, told)
    shown = F.array_join(F.transform("people", lambda p: F.concat_ws(":", p["name"], p["role"])), ";")
    return found.select("site", "name", "nif", "dropped_name", F.array_join("phones", ",").alias("phones"), F.array_join("emails", ",").alias("emails"), shown.alias("people"))


@query(
    """WITH l AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT k, (k % 3 = 0) OR (k % 5 = 0) OR (k % 7 = 0) AS matches FROM l"""
)
def record_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a record found for a company is its own: by number, by phone in another spelling, or by agreeing names."""
    k = F.col("o_orderkey")
    number, phone = F.concat(F.lit("b"), k.cast("string")), F.lpad((k % 1_000_000_000).cast("string"), 9, "6")
    found = site_records.record_matches(
        F.when(k % 3 == 0, F.upper(number)), F.array(F.concat(F.lit("+34"), phone), F.lit("12")), number, F.array(F.when(k % 5 == 0, phone).otherwise("911")), k % 7 == 0
    )
    return read(spark, sf_dir, "orders").select(k.alias("k"), found.alias("matches"))


# Raw records batch by batch


@query(
    """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_custkey AS c, o_orderkey % 2 AS b FROM orders),
m AS (SELECT c, min('c:' || record_id) AS e FROM o WHERE b = 0 GROUP BY 1)
SELECT record_id, CASE WHEN b = 1 AND e IS NOT NULL THEN e ELSE 'c:' || record_id END AS entity, CASE WHEN b = 1 AND e IS NOT NULL THEN 'review' ELSE 'create' END AS action FROM o LEFT JOIN m USING (c)"""
)
def processed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where orders go as raw records of numbers alone, in two batches, the second delivered twice.

    Records of one number and no name are perhaps one company: later ones join the first in doubt.
    """
    k = F.col("o_orderkey")
    none = {name: F.lit(None).cast(kind).alias(name) for name, kind in matching.FIELDS.items() if name not in ("nif", "nif_valid")}
    rows = read(spark, sf_dir, "orders").select(
        k.cast("string").alias("record_id"), F.lit("orders").alias("source"), F.lit("g").alias("source_group"), F.lit(0.8).alias("confidence"), F.col("o_orderdate").alias("observed_at"), F.lit(False).alias("official"),
        F.concat(F.lit("N"), F.col("o_custkey").cast("string")).alias("nif"), F.lit(True).alias("nif_valid"), *none.values(), (k % 2).alias("b"),
    )
    held = Processor(store_of(spark, new_path(spark, "process")))
    as_of = F.lit(AS_OF).cast("timestamp")
    first, _, second = (held.add(b, rows.where(f"b = {b}").drop("b"), as_of) for b in (0, 1, 1))
    return first.unionByName(second).select("record_id", "entity", "action")
