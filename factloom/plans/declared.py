"""Queries over declaration files, gem evidence and text functions, on files written from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import names
from factloom.operators import ignores, lattice, sequence
from factloom.plans.shop import keyed
from factloom.plans.tables import read
from factloom.sources import declarations, gems, project, rbs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


SCHEMA = """ActiveRecord::Schema.define(version: 1) do
  create_table "items{k}"{id}, force: :cascade do |t|
    t.string "name", "brand"
    t.integer "count", default: 0
    t.index ["name"], name: "by_name"
    t.{kind} "extra"
  end
end
"""


@query("""
WITH s AS (SELECT s_suppkey AS k, 'app' || s_suppkey || '/db/schema.rb' AS path, 'items' || s_suppkey AS "table" FROM supplier)
SELECT path, "table", "column", type, CAST(line AS BIGINT) AS line FROM (
  SELECT path, "table", 'id' AS "column", 'integer' AS type, 1 AS line FROM s WHERE k % 3 <> 0 UNION ALL SELECT path, "table", 'name', 'string', 2 FROM s UNION ALL SELECT path, "table", 'brand', 'string', 2 FROM s
  UNION ALL SELECT path, "table", 'count', 'integer', 3 FROM s UNION ALL SELECT path, "table", 'extra', CASE WHEN k % 2 = 0 THEN 'datetime' ELSE 'jsonb' END, 5 FROM s) t
""")
def schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a schema file for each supplier; some tables have no ``id``."""
    k = F.col("s_suppkey")
    files = keyed(spark, sf_dir, "app{k}/db/schema.rb", SCHEMA, id=F.when(k % 3 == 0, ", id: false").otherwise(""), kind=F.when(k % 2 == 0, "datetime").otherwise("jsonb"))
    return declarations.schema_rb(files.select("path", "text"))


DUMP = """SET client_encoding = 'UTF8';
CREATE TABLE public."items{k}" (
    id bigint NOT NULL,
    "name" character varying(255) DEFAULT 'x'::character varying,
    price numeric(10,2) NOT NULL,
    CONSTRAINT positive CHECK ((price > 0)),
    made timestamp without time zone
);
CREATE TABLE extra{k} (
    done boolean DEFAULT false
{end}
"""


@query("""
WITH s AS (SELECT s_suppkey AS k, 'app' || s_suppkey || '/db/structure.sql' AS path FROM supplier)
SELECT path, "table", "column", type, CAST(line AS BIGINT) AS line FROM (
  SELECT path, 'items' || k AS "table", 'id' AS "column", 'integer' AS type, 2 AS line FROM s UNION ALL SELECT path, 'items' || k, 'name', 'string', 3 FROM s UNION ALL SELECT path, 'items' || k, 'price', 'numeric', 4 FROM s
  UNION ALL SELECT path, 'items' || k, 'made', 'timestamp without time zone', 6 FROM s UNION ALL SELECT path, 'extra' || k, 'done', 'boolean', 9 FROM s WHERE k % 4 <> 0) t
""")
def dump_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a database dump for each supplier; a table whose statement does not end is dropped whole."""
    files = keyed(spark, sf_dir, "app{k}/db/structure.sql", DUMP, end=F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(");"))
    return declarations.structure_sql(files.select("path", "text"))


HEADERS = """# typed: true
class Shop{m}::Node < Base
  def size; end
end
module ::Top{k}
  def {test}(other); end
end
LIMIT{k} = T.let(nil, T.untyped)
  INNER{k} = 1
"""


@query("""
WITH s AS (SELECT s_suppkey AS k, 'sorbet/rbi/gems/g' || s_suppkey || '.rbi' AS path FROM supplier)
SELECT 'Shop' || (k % 7) || '::Node' AS name, path, 'class' AS kind FROM s UNION ALL SELECT 'Top' || k, path, 'class' FROM s
UNION ALL SELECT 'LIMIT' || k, path, 'constant' FROM s UNION ALL SELECT '', path, 'type_test' FROM s WHERE k % 5 = 0
""")
def rbi_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that signature files declare; every file that declares a name keeps its row."""
    k = F.col("s_suppkey")
    files = keyed(spark, sf_dir, "sorbet/rbi/gems/g{k}.rbi", HEADERS, m=(k % 7).cast("string"), test=F.when(k % 5 == 0, "is_a?").otherwise("same?"))
    return declarations.rbi_headers(files.select("path", "text"))


LOCK = """GIT
  remote: https://git.example/a.git
  specs:
    from-git{k} (0.{k}.1)

GEM
  remote: https://gems.example/
  specs:
    alpha_{k} (1.{k})
      beta (>= 2)
    beta (2.{m}.0)

DEPENDENCIES
  alpha_{k}
"""


@query("""
WITH s AS (SELECT s_suppkey AS k, 'app' || s_suppkey || '/Gemfile.lock' AS path FROM supplier)
SELECT path, 'GIT' AS section, 'from-git' || k AS gem, '0.' || k || '.1' AS version FROM s UNION ALL SELECT path, 'GEM', 'alpha_' || k, '1.' || k FROM s UNION ALL SELECT path, 'GEM', 'beta', '2.' || (k % 3) || '.0' FROM s
""")
def lock_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locked gems of each section; what a gem needs, indented deeper, is none."""
    return declarations.lock_entries(_locks(spark, sf_dir))


def _locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir, "app{k}/Gemfile.lock", LOCK, m=(F.col("s_suppkey") % 3).cast("string")).select("path", "text")


@query("""
WITH s AS (SELECT s_suppkey AS k FROM supplier),
g AS (SELECT DISTINCT gem, version FROM (SELECT 'from-git' || k AS gem, '0.' || k || '.1' AS version FROM s UNION ALL SELECT 'alpha_' || k, '1.' || k FROM s UNION ALL SELECT 'beta', '2.' || (k % 3) || '.0' FROM s))
SELECT gem, version, CASE WHEN gem = 'beta' THEN 'curated' WHEN gem LIKE 'from-git%' THEN CASE WHEN CAST(substr(gem, 9) AS INT) % 4 = 0 THEN 'native' WHEN CAST(substr(gem, 9) AS INT) % 4 = 1 THEN 'installed' ELSE 'missing' END
  WHEN CAST(substr(gem, 7) AS INT) % 2 = 0 THEN 'declared' ELSE 'missing' END AS status FROM g
""")
def gem_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each locked gem is accounted for: declared at its version, curated, installed, native or missing."""
    return _accounted(spark, sf_dir)


def _accounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    suppliers = read(spark, sf_dir, "supplier").select(k)
    text = k.cast("string")
    rbi = suppliers.select(F.concat(F.lit("alpha_"), text).alias("gem"), F.when(k % 4 == 0, F.concat(F.lit("1."), text)).when(k % 4 == 2, F.concat(F.lit("1."), text, F.lit("-abcdef"))).otherwise(F.concat(F.lit("9."), text)).alias("version"))
    installed = suppliers.filter(k % 4 < 2).select(F.concat(F.lit("from-git"), text).alias("gem"), F.concat(F.lit("0."), text, F.lit(".1")).alias("version"), (k % 4 == 0).alias("native"))
    return gems.accounting(declarations.lock_entries(_locks(spark, sf_dir)), rbi, spark.createDataFrame([("beta",)], "gem string"), installed)


@query("SELECT false AS closed, min(CASE WHEN s_suppkey % 2 = 1 THEN 'alpha_' || s_suppkey || ': missing' END) AS reason FROM supplier")
def world_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the world closed, and the first reason why not."""
    return gems.evidence(_accounted(spark, sf_dir))


@query("""
WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'active-model_' || k || '-rails' AS gem, 'Active::Model' || k || '::Rails' AS namespace FROM s
""")
def gem_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    gem = F.concat(F.lit("active-model_"), F.col("s_suppkey").cast("string"), F.lit("-rails"))
    return read(spark, sf_dir, "supplier").select(gem.alias("gem")).withColumn("namespace", declarations.gem_namespace(F.col("gem")))


@query("""
WITH p AS (SELECT p_partkey, '/a b/' || p_name || '/é+~*' || p_partkey || '.rb' AS path FROM part)
SELECT p_partkey, replace(replace(replace(replace(path, ' ', '%20'), 'é', '%C3%A9'), '+', '%2B'), '*', '%2A') AS uri, path AS again FROM p
""")
def uri_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as they stand in a URI, and back."""
    path = F.concat(F.lit("/a b/"), "p_name", F.lit("/é+~*"), F.col("p_partkey").cast("string"), F.lit(".rb"))
    uri = names.percent_encode(path)
    return read(spark, sf_dir, "part").select("p_partkey", uri.alias("uri"), names.percent_decode(uri).alias("again"))


@query("""
WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '' ELSE 'Shop' || (p_partkey % 4) END AS scope, CASE p_partkey % 3 WHEN 0 THEN 'Item' WHEN 1 THEN 'item' ELSE 'Item::Leaf_2' END AS name FROM part)
SELECT k, CASE WHEN scope = '' THEN name ELSE scope || '::' || name END AS path, k % 3 <> 1 AS constant FROM p
""")
def constant_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope and name joined, and whether that is the path of a constant."""
    k = F.col("p_partkey")
    scope = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Shop"), (k % 4).cast("string")))
    name = F.when(k % 3 == 0, "Item").when(k % 3 == 1, "item").otherwise("Item::Leaf_2")
    path = names.join_path(scope, name)
    return read(spark, sf_dir, "part").select(k.alias("k"), path.alias("path"), names.is_constant_path(path).alias("constant"))


@query("""
WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'numeric(10,2)' WHEN 1 THEN 'character varying(255)' WHEN 2 THEN 'BIGINT' WHEN 3 THEN 'bool' WHEN 4 THEN 'citext' ELSE 'timestamp(6) without time zone' END AS raw,
  CASE p_partkey % 3 WHEN 0 THEN '"' || p_brand || '"' WHEN 1 THEN ' `' || p_brand || '` ' ELSE p_brand END AS quoted, p_brand FROM part)
SELECT k, CASE k % 6 WHEN 0 THEN 'numeric' WHEN 1 THEN 'string' WHEN 2 THEN 'integer' WHEN 3 THEN 'boolean' WHEN 4 THEN 'string' ELSE 'timestamp without time zone' END AS type, p_brand AS name FROM p
""")
def sql_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL spellings as canonical types, and quoted names without their quotes."""
    k = F.col("p_partkey")
    raw = F.when(k % 6 == 0, "numeric(10,2)").when(k % 6 == 1, "character varying(255)").when(k % 6 == 2, "BIGINT").when(k % 6 == 3, "bool").when(k % 6 == 4, "citext").otherwise("timestamp(6) without time zone")
    quoted = F.when(k % 3 == 0, F.concat(F.lit('"'), "p_brand", F.lit('"'))).when(k % 3 == 1, F.concat(F.lit(" `"), "p_brand", F.lit("` "))).otherwise(F.col("p_brand"))
    return read(spark, sf_dir, "part").select(k.alias("k"), names.sql_type(raw).alias("type"), names.strip_quotes(quoted).alias("name"))


@query("""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
rows AS (SELECT doc_id, unnest(a) AS content, unnest(range(len(a))) AS line FROM parts),
lines AS (SELECT doc_id, CAST(line AS BIGINT) AS line, content, coalesce(sum(strlen(content) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rows)
SELECT doc_id, line, CAST(9 AS BIGINT) AS "column", CAST(start + strlen(left(content, 9)) AS BIGINT) AS "offset" FROM lines
""")
def offset_of_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offset of column 9 of every line of every document; beyond the line's end, its end.  (The documents have no character of two units.)"""
    docs = read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    lines = sequence.lines(docs, "doc_id", "text")
    places = lines.select("doc_id", "line", F.lit(9).cast("long").alias("column"))
    return sequence.offset_of(places, lines, "doc_id", "line", "column").select("doc_id", "line", "column", "offset")


@query("""
WITH p AS (SELECT p_partkey AS k FROM part)
SELECT k, CASE k % 5 WHEN 0 THEN 'Integer,String | nil' WHEN 1 THEN 'Array,Part' || k WHEN 2 THEN '' WHEN 3 THEN 'untyped' ELSE NULL END AS params,
  CASE k % 5 WHEN 0 THEN 'String' WHEN 1 THEN 'Float | nil' WHEN 2 THEN 'bool' WHEN 3 THEN 'untyped' ELSE NULL END AS returns FROM p
""")
def signature_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature comments as types; one that is malformed has none."""
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, "(Integer, String?) -> String").when(k % 5 == 1, F.concat(F.lit("(Array[Hash[Symbol, Integer]] list, Part"), k.cast("string"), F.lit(") -> Float?"))).when(k % 5 == 2, "-> bool").when(k % 5 == 3, "(^(Integer) -> String) -> singleton(Foo)").otherwise("(Integer -> String")
    return parsed(read(spark, sf_dir, "part").select(k.alias("k"), text.alias("text")), "k", "text")


def parsed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, and the parameters and result that a signature comment states; nulls where it is malformed."""
    import pyarrow as pa

    from factloom.sources.shipping import ship

    ship(rows.sparkSession)
    src = rows.select(key, text)
    schema = T.StructType([src.schema[key], T.StructField("params", T.StringType()), T.StructField("returns", T.StringType())])

    def run(batches):
        for b in batches:
            params, returns = [], []
            for t in b.column(1).to_pylist():
                try:
                    sig = rbs.signature(t)
                    params.append(",".join(rbs.render(x) for _, x in sig.params))
                    returns.append(rbs.render(sig.returns))
                except rbs.Invalid:
                    params.append(None)
                    returns.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(params, pa.string()), pa.array(returns, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)


@query("""
WITH t AS (SELECT user_id, event_id % 20 AS slot, list_sort(list_distinct(list(CASE event_type WHEN 'view' THEN 'nil' WHEN 'error' THEN 'Array[String]' ELSE event_type END))) AS m FROM events GROUP BY 1, 2)
SELECT user_id, slot, CASE WHEN len(list_filter(m, lambda x: x <> 'nil')) = 0 THEN 'untyped' ELSE array_to_string(list_transform(list_filter(m, lambda x: x <> 'nil'), lambda x: CASE WHEN x = 'Array[String]' THEN 'Array' ELSE x END), '|') END AS type FROM t
""")
def strip_and_erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types without nil (nil alone is unknown), and collections without their elements."""
    atom = F.when(F.col("event_type") == "view", "nil").when(F.col("event_type") == "error", "Array[String]").otherwise(F.col("event_type"))
    got = read(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 20).alias("slot")).agg(F.array_sort(F.collect_set(atom)).alias("m"))
    return got.select("user_id", "slot", F.array_join(F.transform(lattice.strip_nil(F.col("m")), lattice.erase), "|").alias("type"))


@query("""
WITH f AS (SELECT s_suppkey AS k, unnest(['app/a.rb', 'db/schema.rb', 'db/structure.sql', 'sorbet/rbi/gems/x.rbi', 'Gemfile.lock', 'vendor/v.rb', 'app/readme.md', 'skip/s.rb']) AS file FROM supplier)
SELECT 'p' || k || '/' || file AS path, CASE file WHEN 'app/a.rb' THEN 'project' WHEN 'db/schema.rb' THEN 'schema_rb' WHEN 'db/structure.sql' THEN 'structure_sql' WHEN 'sorbet/rbi/gems/x.rbi' THEN 'rbi' WHEN 'Gemfile.lock' THEN 'lock' ELSE 'ignored' END AS role
FROM f WHERE file <> 'app/readme.md'
""")
def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of the files of a tree; what is ignored by an entry or a skipped folder only silences."""
    files = F.array(*(F.lit(x) for x in ("app/a.rb", "db/schema.rb", "db/structure.sql", "sorbet/rbi/gems/x.rbi", "Gemfile.lock", "vendor/v.rb", "app/readme.md", "skip/s.rb")))
    rows = read(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string"), F.lit("/")).alias("top"), F.explode(files).alias("file"))
    return project.classify(rows.select(F.concat("top", "file").alias("path"), F.lit("").alias("text")), ["skip"]).select("path", "role")


@query(r"""
WITH p AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS b, p_type AS t, split_part(p_name, ' ', 1) AS w, split_part(p_name, ' ', 2) || '_' || p_partkey || '.rb' AS n FROM part)
SELECT 'lib/' || b || '/' || t || '/' || w || '/' || n AS path,
  t = 'LARGE' OR (t = 'PROMO' AND w = 'hot') OR (b % 2 = 1 AND t = 'SMALL' AND w <> 'red') OR (b % 5 = 0 AND t = 'ECONOMY')
  OR CASE WHEN b % 2 = 0 THEN regexp_matches(n, '^bolt_.*7[.]rb$') WHEN regexp_matches(n, '^gear_[0-4].*[.]rb$') THEN true
    WHEN regexp_matches(n, '^ring_.*[.]rb$') THEN false ELSE regexp_matches(n, '_.5[.]rb$') END AS excluded
FROM p
""")
def ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of a tree its ignore files exclude: rules at the root and in every second level, some taken back, some for good."""
    part = read(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", "[0-9]+", 0)
    words = F.split("p_name", " ")
    paths = part.select(F.concat(F.lit("lib/"), brand, F.lit("/"), "p_type", F.lit("/"), words[0], F.lit("/"), words[1], F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".rb")).alias("path"))
    top = spark.range(1).select(F.lit(".gitignore").alias("path"), F.lit("# parts\n*_?5.rb\n/lib/*/LARGE/\nPROMO/hot/\n**/PROMO/hot/\n!ring_*.rb  \ngear_[0-4]*.rb\n").alias("text"))
    own = part.select(brand.alias("b")).distinct()
    odd = F.col("b").cast("int") % 2 == 1
    below = own.select(F.concat(F.lit("lib/"), "b", F.lit("/.gitignore")).alias("path"), F.when(odd, "/SMALL/*\n!/SMALL/red/\n").otherwise("!*.rb\r\nbolt_*7.rb\r\n").alias("text"))
    final = own.filter(F.col("b").cast("int") % 5 == 0).select(F.concat(F.lit("lib/"), "b", F.lit("/.ignore")).alias("path"), F.lit("ECONOMY").alias("text"))
    gone = ignores.excluded(paths, ignores.rules(top.unionAll(below).unionAll(final)))
    return paths.distinct().join(gone.withColumn("excluded", F.lit(True)), "path", "left").fillna(False, ["excluded"])
