"""Text, hash and screening queries over the generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestia.functions import hashing as H
from attestia.functions import text as T
from attestia.plans.registry import registry, trimmed
from attestia.session import table

QUERIES, ORACLES, query = registry()


def HMAC_SQL(column: str, key: bytes = b"example key") -> str:  # noqa: N802
    """HMAC-SHA-256 of a text column, from the plain digest."""
    pads = ["".join(f"\\x{b ^ x:02X}" for b in key.ljust(64, b"\0")) for x in (0x36, 0x5C)]
    return f"sha256('{pads[1]}'::blob || unhex(sha256('{pads[0]}'::blob || encode({column}))))"


@query(f"select doc_id, regexp_replace({trimmed("chr(9) || replace(text, 'e', 'e' || chr(1614)) || chr(10) || chr(160)")}," + r""" '[\x{064B}-\x{065F}\x{0670}]', '', 'g') as plain,
  regexp_matches(text, '[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]') as arabic from documents""")
def strip_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("\t"), F.replace(F.col("text"), F.lit("e"), F.lit("eَ")), F.lit("\n\u00a0"))
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_diacritics(marked).alias("plain"), T.has_arabic_letter(F.col("text")).alias("arabic"))


@query(r"""select p_partkey, try_cast(case when p_partkey % 7 = 0 then null else (case when p_partkey % 2 = 0 then '-' else '' end) || p_partkey end as bigint) as value from part""")
def digits_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers written with Arabic-Indic digits and a minus sign; every seventh is malformed."""
    key = F.col("p_partkey")
    sign = F.when(key % 2 == 0, F.lit("−")).otherwise("")
    arabic = F.translate(key.cast("string"), "0123456789", "".join(map(chr, range(0x660, 0x66A))))
    written = F.concat(sign, arabic, F.when(key % 7 == 0, F.lit("x")).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", T.parse_integer(written).alias("value"))


@query("select p_partkey, 'Part ' || p_name || ' of ' || p_brand || ': ' || p_name as line, 3 as places from part")
def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.lit("Part {name} of {brand}: {name}")
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.render_template(template, {"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("line"), F.size(T.placeholders(template)).alias("places")
    )


@query("""select p_partkey, case when p_size % 5 = 0 then null else 4 end as n, case when p_size % 5 = 0 then null else '"' || p_name || '"' end as second from part""")
def tokens_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a statement with a quoted name; every fifth size leaves a quote open."""
    line = F.concat(F.lit('define "'), F.col("p_name"), F.lit('" by '), F.col("p_brand"), F.when(F.col("p_size") % 5 == 0, F.lit(' "')).otherwise(""))
    tokens = T.tokens_quoted(line)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(tokens.isNotNull(), F.size(tokens)).alias("n"), tokens[1].alias("second"))


_FLAGS = r"""regexp_matches(text, '[^\s@]+@[^\s@]+\.[^\s@]+') as email, regexp_matches(text, '(?:\+?\d[\s().-]*){7,}') as phone,
  regexp_matches(text, '(?i)</?[a-z][^>]*>') as raw_html, regexp_matches(text, '!\[[^\]]*\]\s*\(') as markdown_image,
  regexp_matches(text, '(?i)\b(?:javascript|data):') as unsafe_url, regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') as control"""


@query(f"""with t as (select 'd' as kind, doc_id as id, text from documents union all select 'p', page_id, html from pages union all select 'c', conv_id * 1000 + turn, text from conversations)
select kind, id, {_FLAGS} from t""")
def unsafe_text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = (
        table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text")
        .unionAll(table(spark, sf_dir, "pages").select(F.lit("p"), "page_id", "html"))
        .unionAll(table(spark, sf_dir, "conversations").select(F.lit("c"), F.col("conv_id") * 1000 + F.col("turn"), "text"))
    )
    return texts.select("kind", "id", *[c.alias(n) for n, c in T.unsafe_flags(F.col("text")).items()])


@query(r"select doc_id, substring(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 160) as excerpt from documents")
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), 160).alias("excerpt"))


@query("""select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as safe,
  regexp_replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '@', '@' || chr(8203)), '|', '&#124;'), '\\r?\\n', '<br>', 'g') as cell from pages""".replace("\\\\", "\\"))
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("safe"), T.table_cell(F.col("html")).alias("cell"))


@query("""select doc_id, sha256(strlen(cast(doc_id as varchar)) || ':' || doc_id || coalesce(strlen(text) || ':' || text, '-1:') || coalesce(strlen(nullif(lang, 'en')) || ':' || nullif(lang, 'en'), '-1:')) as root from documents""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.nullif(F.col("lang"), F.lit("en"))
    return table(spark, sf_dir, "documents").select("doc_id", H.canonical_hash(F.col("doc_id"), F.col("text"), lang).alias("root"))


@query("""select count(*) as n_rows, sha256(string_agg(line, chr(10) order by line)) as digest from (
  select strlen(cast(n_nationkey as varchar)) || ':' || n_nationkey || '|' || strlen(n_name) || ':' || n_name as line from nation)""")
def rowset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.rowset_profile(table(spark, sf_dir, "nation"), "n_nationkey", "n_name")


@query("""with lines as (select sha256(strlen(cast(o_orderkey as varchar)) || ':' || o_orderkey || '|' || strlen(o_orderstatus) || ':' || o_orderstatus) as line from orders),
leaves as (select left(line, 2) as range, count(*) as n, sha256(string_agg(line, chr(10) order by line)) as leaf from lines group by left(line, 2))
select cast(sum(n) as bigint) as n_rows, sha256(string_agg(leaf, chr(10) order by range)) as digest from leaves""")
def rowset_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.rowset_tree(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus").select("n_rows", "digest")


@query("""select event_id, sha256('{"a":[' || event_id || ',1000,' || event_id || '.5,1e+21,0],"k":' || json_extract_string(props, '$.k') || '}') as digest from events""")
def canonical_json_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of JSON texts with keys in any order and numbers in any form."""
    number = F.col("event_id").cast("string")
    text = F.concat(F.lit('{ "k" : '), F.get_json_object("props", "$.k"), F.lit('.0, "a": ['), number, F.lit(".0, 1e3, "), number, F.lit(".50e0, 1E21, -0.0]}"))
    return table(spark, sf_dir, "events").select("event_id", H.canonical_json_hash(text).alias("digest"))


@query("""select count(*) as files, cast(sum(bytes) as bigint) as bytes, sha256(string_agg(line, '' order by path)) as root from (
  select 'd/' || lpad(cast(doc_id as varchar), 9, '0') as path, strlen(text) as bytes, sha256(text) || ' ' || strlen(text) || ' ' || 'd/' || lpad(cast(doc_id as varchar), 9, '0') || chr(10) as line
  from documents)""")
def manifest_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root digest of a file list: digest, size and path of each file, in path order."""
    from attestia.sources.manifests import root

    path = F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    return root(table(spark, sf_dir, "documents").select(path.alias("path"), F.encode("text", "utf-8").alias("content")))


@query("""with files as (select 'd/' || lpad(cast(doc_id as varchar), 9, '0') as path, strlen(text) as bytes, sha256(text) || ' ' || strlen(text) || ' ' || 'd/' || lpad(cast(doc_id as varchar), 9, '0') || chr(10) as line from documents),
leaves as (select left(sha256(path), 2) as range, count(*) as n, sum(bytes) as bytes, sha256(string_agg(line, '' order by path)) as leaf from files group by left(sha256(path), 2))
select cast(sum(n) as bigint) as files, cast(sum(bytes) as bigint) as bytes, sha256(string_agg(leaf, chr(10) order by range)) as root from leaves""")
def manifest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root digest of all documents in two levels, shared among tasks."""
    from attestia.sources.manifests import root_tree

    path = F.concat(F.lit("d/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    return root_tree(table(spark, sf_dir, "documents").select(path.alias("path"), F.encode("text", "utf-8").alias("content")))


@query("""select doc_id, source from documents where contains(lower(concat_ws(' ', source, lang, text)), lower('The Thanin')) and lang = 'en'""")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    haystack = F.lower(F.concat_ws(" ", "source", "lang", "text"))
    return table(spark, sf_dir, "documents").filter((F.col("lang") == "en") & haystack.contains("the thanin")).select("doc_id", "source")


@query("""select conv_id, turn, case when state = 'redacted' then '[redacted]' else text end as body, coalesce(nullif(state, ''), 'visible') as state from (
  select *, case turn % 4 when 0 then null when 1 then 'redacted' when 2 then '' else case when conv_id % 3 = 0 then 'hidden' else 'visible' end end as state from conversations)
where coalesce(nullif(state, ''), 'visible') not in ('hidden', 'blocked')""")
def comments_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn") % 4
    state = F.when(turn == 0, None).when(turn == 1, "redacted").when(turn == 2, "").when(F.col("conv_id") % 3 == 0, "hidden").otherwise("visible")
    shown = F.coalesce(F.nullif(state, F.lit("")), F.lit("visible"))
    body = F.when(shown == "redacted", "[redacted]").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"), shown.alias("state")).filter(~F.col("state").isin("hidden", "blocked"))


@query("""select c_custkey, case when erased then null else c_name end as c_name, case when erased then null else c_acctbal end as c_acctbal, erased from (
  select *, exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 495000) as erased from customer)""")
def erasure_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that asked for erasure show no personal values."""
    asked = table(spark, sf_dir, "orders").filter("o_totalprice > 495000").select(F.col("o_custkey").alias("k")).distinct().withColumn("hit", F.lit(True))
    people = table(spark, sf_dir, "customer").join(asked, F.col("c_custkey") == F.col("k"), "left").withColumn("erased", F.coalesce("hit", F.lit(False)))
    keep = lambda c: F.when(~F.col("erased"), F.col(c)).alias(c)
    return people.select("c_custkey", keep("c_name"), keep("c_acctbal"), "erased")


@query("""select supplier.s_suppkey, rtrim(translate(to_base64(encode(s_name)), '+/', '-_'), '=') as path,
  regexp_matches(s_name, '^[A-Za-z0-9][A-Za-z0-9._:-]{0,159}$') as identifier, sha256(s_name) as digest from supplier""")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.base64url(n).alias("path"), n.rlike(T.IDENTIFIER).alias("identifier"), F.sha2(n, 256).alias("digest"))


@query(f"select c_custkey, {HMAC_SQL('c_name')} as signature from customer")
def keyed_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HMAC-SHA-256 of names from built-in functions."""
    return table(spark, sf_dir, "customer").select("c_custkey", H.hmac_sha256(F.col("c_name"), b"example key").alias("signature"))


@query("""select doc_id, part, cast(case when part = n - 1 then strlen(text) - part * 1000 else 1000 end as int) as bytes from (
  select doc_id, text, greatest(cast(ceil(strlen(text) / 1000.0) as int), 1) as n, unnest(range(greatest(cast(ceil(strlen(text) / 1000.0) as int), 1))) as part from documents)""")
def backup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attestia.operators.queues import chunks

    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    return chunks(docs, "content", 1000).select("doc_id", F.col("part").cast("long").alias("part"), "bytes")


@query("""select event_id, strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as iso, case when event_id % 5 > 0 then epoch_us(ts) // 1000 end as ms from events""")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as ISO text and read back; every fifth text is malformed."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    iso = T.iso_utc(ms)
    spoiled = F.when(F.col("event_id") % 5 == 0, F.replace(iso, F.lit("T"), F.lit(" "))).otherwise(iso)
    return table(spark, sf_dir, "events").select("event_id", iso.alias("iso"), T.iso_millis(spoiled).alias("ms"))


@query("""select o_orderkey, sha256('{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '","note":null}') as digest from orders""")
def insertion_json_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of JSON in the order its fields were given, nulls kept."""
    value = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("note"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256).alias("digest"))


@query("""select event_id, event_type in ('click', 'purchase', 'error') as forbidden from events""")
def forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON with a private key at some depth, with one whose name hides it, without, and malformed (rejected)."""
    kind = F.col("event_type")
    key = F.when(kind == "click", "E-Mail").when(kind == "purchase", "userIdentityCode").otherwise("note")
    text = F.concat(F.lit('{"a": [{"'), key, F.lit('": '), F.col("props"), F.lit("}]"), F.when(kind == "error", "").otherwise("}"))
    found = T.has_forbidden_key(text, ("email", "phone"), ("identity", "provider"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(found, F.lit(True)).alias("forbidden"))


@query("""select doc_id, case when starts_with(text, 'A') and length(text) > 2000 then 'packet' when source in ('src1', 'src2') then 'annotation' when lang = 'fr' then 'decision' else 'unknown' end as kind from documents""")
def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents classified by shape; the first rule that holds decides."""
    kind = F.when(F.col("text").startswith("A") & (F.length("text") > 2000), "packet").when(F.col("source").isin("src1", "src2"), "annotation")
    return table(spark, sf_dir, "documents").select("doc_id", kind.when(F.col("lang") == "fr", "decision").otherwise("unknown").alias("kind"))


@query("""select p_name, row_number() over (order by lower(p_name)) as place from (select distinct p_name from part)""")
def locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in locale order (a Unicode collation) rather than by bytes."""
    from attestia.operators.ordered import numbered

    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return numbered(names, F.collate(F.col("p_name"), "UNICODE"), out="place")
