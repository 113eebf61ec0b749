"""String functions over whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.analytics.derive import choice
from quillon.analytics.registry import query, table
from quillon.functions import numbers, texts
from quillon.operators import checks

NAMES = choice("s_suppkey", ["Acme Works Co., Ltd", "Blue-Sky  Trading LLC", "  North (East) Steel Inc", "Delta Corp", "Omega Foods Limited", "Sunny GmbH", "Plain Name"])
SUPPLIERS = f"s AS (SELECT s_suppkey, {NAMES[1]} AS name FROM supplier)"


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", F.expr(NAMES[0]).alias("name"))


CLEANED = "trim(regexp_replace(regexp_replace(lower(name), '[^0-9a-z]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"WITH {SUPPLIERS} SELECT s_suppkey, {CLEANED} AS cleaned FROM s")
def s_clean_field(spark: SparkSession, sf: str) -> DataFrame:
    """A field's name trimmed, lowered, without punctuation."""
    return _suppliers(spark, sf).select("s_suppkey", texts.clean_field(F.col("name")).alias("cleaned"))


@query(f"WITH {SUPPLIERS} SELECT s_suppkey, lower(regexp_replace(name, '[\\s.,()-]+', '', 'g')) AS name FROM s")
def s_norm_name(spark: SparkSession, sf: str) -> DataFrame:
    """A party's name without blanks and punctuation."""
    return _suppliers(spark, sf).select("s_suppkey", texts.norm_name(F.col("name")).alias("name"))


@query(f"""
WITH {SUPPLIERS}, c AS (SELECT s_suppkey, {CLEANED} AS c FROM s) SELECT s_suppkey, trim(regexp_replace(c, ' ?(incorporated|corporation|limited|company|corp|gmbh|inc|ltd|llc|co)$', '')) AS stem FROM c
""")
def s_company_suffix(spark: SparkSession, sf: str) -> DataFrame:
    """A company's name without its legal suffix, the longest, once."""
    return _suppliers(spark, sf).select("s_suppkey", texts.company_stem(F.col("name")).alias("stem"))


@query("""
SELECT s_suppkey, regexp_replace(upper('91-3x ' || lpad((s_suppkey * 7)::VARCHAR, 6, '0')), '[^0-9A-Z]', '', 'g') AS code, right('86' || lpad((13000000000 + s_suppkey)::VARCHAR, 11, '0'), 11) AS phone, (6222000000 + s_suppkey)::VARCHAR AS account FROM supplier
""")
def s_norm_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Registration codes, telephone and account numbers written with marks, brought to one form."""
    key = F.col("s_suppkey")
    code = F.concat(F.lit("91-3x "), F.lpad((key * 7).cast("string"), 6, "0"))
    phone = F.concat(F.lit("+86 "), F.regexp_replace((13_000_000_000 + key).cast("string"), "^(...)(....)", "$1-$2-"))
    account = F.concat_ws(" ", F.left((6_222_000_000 + key).cast("string"), F.lit(4)), F.substring((6_222_000_000 + key).cast("string"), 5, 6))
    return table(spark, sf, "supplier").select("s_suppkey", texts.norm_code(code).alias("code"), texts.norm_phone(phone).alias("phone"), texts.norm_code(account).alias("account"))


CHARS = "0123456789ABCDEFGHJKLMNPQRTUWXY"


@query(f"""
WITH c AS (SELECT c_custkey, '91' || lpad((c_custkey * 7919 % 1000000)::VARCHAR, 6, '0') || lpad((c_custkey * 31)::VARCHAR, 9, '7') AS body FROM customer),
s AS (SELECT c_custkey, body, (SELECT sum((strpos('{CHARS}', substr(body, i, 1)) - 1) * w) FROM (SELECT unnest([1,3,9,27,19,26,16,17,20,29,25,13,8,24,10,30,28]) AS w, unnest(range(1, 18))::INT AS i))::INT AS t FROM c),
f AS (SELECT c_custkey, body, substr('{CHARS}', (31 - t % 31) % 31 + 1, 1) AS last FROM s)
SELECT c_custkey, true AS right_code, last = '7' AS with_seven FROM f
""")
def s_uscc(spark: SparkSession, sf: str) -> DataFrame:
    """Credit codes of 18 characters: those that end in the character their weights ask for, modulo 31, and no others."""
    key = F.col("c_custkey")
    body = F.concat(F.lit("91"), F.lpad((key * 7919 % 1_000_000).cast("string"), 6, "0"), F.lpad((key * 31).cast("string"), 9, "7"))
    fits = F.exists(F.split(F.lit(CHARS), ""), lambda c: (c != "") & numbers.credit_code(F.concat(body, c)))
    return table(spark, sf, "customer").select("c_custkey", fits.alias("right_code"), numbers.credit_code(F.concat(body, F.lit("7"))).alias("with_seven"))


@query("""
WITH n AS (SELECT o_orderkey, lpad((o_orderkey * 104729)::VARCHAR, 15, '6') AS c FROM orders),
s AS (SELECT o_orderkey, c, (SELECT sum(CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * substr(c, i, 1)::INT > 9 THEN 2 * substr(c, i, 1)::INT - 9 ELSE 2 * substr(c, i, 1)::INT END ELSE substr(c, i, 1)::INT END) FROM (SELECT unnest(range(1, 16))::INT AS i))::INT AS t FROM n)
SELECT o_orderkey, (t + 5) % 10 = 0 AS ok, false AS short FROM s
""")
def s_card_luhn(spark: SparkSession, sf: str) -> DataFrame:
    """Card numbers with blanks and dashes; fewer than 13 digits are none."""
    bare = F.lpad((F.col("o_orderkey") * 104_729).cast("string"), 15, "6")
    card = F.concat_ws("-", F.left(bare, F.lit(4)), F.substring(bare, 5, 4), F.concat_ws(" ", F.substring(bare, 9, 4), F.concat(F.substring(bare, 13, 3), F.lit("5"))))
    return table(spark, sf, "orders").select("o_orderkey", numbers.luhn(card).alias("ok"), numbers.luhn(F.left(bare, F.lit(12))).alias("short"))


@query("SELECT c_custkey, 'TK-' || upper(left(sha256('salt' || c_name), 16)) AS token FROM customer")
def s_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    """A stable pseudonym of every name."""
    return table(spark, sf, "customer").select("c_custkey", texts.token(F.col("c_name"), "salt").alias("token"))


@query("SELECT p_partkey, ((p_size // 10) * 10)::VARCHAR || '-' || ((p_size // 10) * 10 + 9)::VARCHAR AS band FROM part")
def s_generalize(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers as the decade they lie in."""
    return table(spark, sf, "part").select("p_partkey", texts.decade(F.col("p_size")).alias("band"))


@query("SELECT c_custkey, round(c_acctbal * (1 + 0.002788535969157674), 2) AS noisy FROM customer")
def s_perturb(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts under seeded noise of one per cent; the seed makes the factor one constant."""
    return table(spark, sf, "customer").select("c_custkey", texts.perturbed(F.col("c_acctbal")).alias("noisy"))


SAMPLES = {"contact_email": ["a1@x.org", "b.c@y.com", "none"], "id_number": ["110101199003071234", "11010119900307123X", "n/a"], "phone_no": ["13812345678", "13900001111", "13700002222"], "note": ["plain", "10.0.0.1", "more text"]}


@query("""
WITH s AS (SELECT c_custkey, unnest(['contact_email', 'id_number', 'phone_no', 'note']) AS field, unnest([(['a1@x.org', 'b.c@y.com', 'none'])[c_custkey % 3 + 1], (['110101199003071234', '11010119900307123X', 'n/a'])[c_custkey % 3 + 1], (['13812345678', '13900001111', '13700002222'])[c_custkey % 3 + 1], (['plain', '10.0.0.1', 'more text'])[c_custkey % 3 + 1]]) AS v FROM customer),
k AS (SELECT * FROM (VALUES ('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', 'email', 2), ('id18', '\\b[0-9]{17}[0-9Xx]\\b', 'id_', 4), ('mobile', '\\b1[3-9][0-9]{9}\\b', 'phone', 3), ('ip', '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b', 'address', 1)) AS t(kind, p, word, level)),
c AS (SELECT field, kind, level, 0.6 * avg(regexp_matches(v, p)::INT) + CASE WHEN contains(field, word) THEN 0.4 ELSE 0 END AS confidence FROM s, k GROUP BY field, kind, level, word),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY confidence DESC, kind) AS n FROM c WHERE confidence > 0)
SELECT field, kind, level, round(confidence, 6) AS confidence FROM r WHERE n = 1
""")
def s_pii_classify(spark: SparkSession, sf: str) -> DataFrame:
    """What kind of personal data a column holds: share of its values that match (.6) and a word in its name (.4)."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.element_at(F.array(*map(F.lit, v)), (F.col("c_custkey") % 3 + 1).cast("int")).alias("v")) for f, v in SAMPLES.items()])
    rows = table(spark, sf, "customer").select(F.explode(fields).alias("x")).select("x.*")
    return checks.column_kinds(rows, "field", "v", {"email": "email", "id18": "id_", "mobile": "phone", "ip": "address"}).select("field", "kind", "level", F.round("confidence", 6).alias("confidence"))


@query("""
SELECT doc_id, len(regexp_extract_all(' ' || regexp_replace(lower(translate(text, chr(10) || '.,;:!?', '       ')), ' ', '  ', 'g') || ' ', ' the ')) AS n FROM documents WHERE lang = 'en'
""")
def s_count_word(spark: SparkSession, sf: str) -> DataFrame:
    """How often a whole word occurs in English texts, whatever its case."""
    clean = F.translate("text", "\n.,;:!?", "       ")
    padded = F.concat(F.lit(" "), F.regexp_replace(clean, " ", "  "), F.lit(" "))
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.regexp_count(padded, F.lit("(?i) the ")).alias("n"))


CLAUSES = choice("o_orderkey", ["A party means any signer; the supplier must deliver in time.", "Buyers may return goods. A fine of up to 5,000 applies; penalty 300 for delay.", "It is so.", "应当按时付款。违者罚款 2000 元；甲方有权解除合同", "Goods are defined as listed items! No; yes? Sellers shall pay a penalty of 12,500.", ""])


@query(f"""
WITH t AS (SELECT o_orderkey, {CLAUSES[1]} AS t FROM orders), c AS (SELECT o_orderkey, list_filter(list_transform(regexp_split_to_array(t, '[.;!?。；！？\\n]'), lambda x: trim(x)), lambda x: length(x) > 5) AS c FROM t)
SELECT o_orderkey, len(c) AS n, coalesce(array_to_string(c, '|'), '') AS clauses FROM c
""")
def s_split_clause(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses between sentence marks, the short ones dropped."""
    c = table(spark, sf, "orders").select("o_orderkey", texts.clauses(F.expr(CLAUSES[0])).alias("c"))
    return c.select("o_orderkey", F.size("c").alias("n"), F.concat_ws("|", "c").alias("clauses"))


@query(f"""
WITH t AS (SELECT o_orderkey, {CLAUSES[1]} AS t FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(t, 'means|refers to|defined as|是指') THEN 'definition' WHEN regexp_matches(t, 'must|shall|required to|不得|应当') THEN 'obligation' WHEN regexp_matches(t, 'may|entitled to|有权|可以') THEN 'right' ELSE 'other' END AS kind FROM t
""")
def s_clause_type(spark: SparkSession, sf: str) -> DataFrame:
    """Definition, obligation, right or other, in this order."""
    return table(spark, sf, "orders").select("o_orderkey", texts.clause_kind(F.expr(CLAUSES[0])).alias("kind"))


@query(f"""
WITH t AS (SELECT o_orderkey, {CLAUSES[1]} AS t FROM orders)
SELECT o_orderkey, coalesce(array_to_string(list_slice(regexp_extract_all(t, '(?:fine|penalty|罚款)[^.;。；]{{0,20}}?[0-9]+(?:,[0-9]{{3}})*'), 1, 3), '|'), '') AS penalties FROM t
""")
def s_penalty(spark: SparkSession, sf: str) -> DataFrame:
    """The first three penalties that a clause names."""
    return table(spark, sf, "orders").select("o_orderkey", F.concat_ws("|", texts.penalties(F.expr(CLAUSES[0]))).alias("penalties"))


RULINGS = choice("o_custkey", ["第一章 general terms of the new order apply\n第二章 short\n第三章 every seller reports its prices each quarter", "1. The board meets twice every year at least\n2. no\n2.1. Minutes are kept for ten years by the clerk", "no heading in here but a long enough text"])


@query(f"""
WITH t AS (SELECT o_orderkey, {RULINGS[1].replace(chr(10), "' || chr(10) || '")} AS t FROM orders), p AS (SELECT o_orderkey, list_filter(list_transform(regexp_split_to_array(t, '(?:^|\\n)(?:第[0-9一二三四五六七八九十]+[章节条]|[0-9]+(?:\\.[0-9]+)*[.、])[ \\t]*'), lambda x: trim(x)), lambda x: length(x) > 20) AS p FROM t)
SELECT o_orderkey, len(p) AS n, coalesce(array_to_string(p, '|'), '') AS sections FROM p
""")
def s_sections(spark: SparkSession, sf: str) -> DataFrame:
    """A regulation cut at its numbered headings, short pieces dropped."""
    p = table(spark, sf, "orders").select("o_orderkey", texts.sections(F.expr(RULINGS[0].replace("\n", "\\n"))).alias("p"))
    return p.select("o_orderkey", F.size("p").alias("n"), F.concat_ws("|", "p").alias("sections"))


EVIDENCE = choice("o_orderkey", ["Mr. Smith of Acme Ltd paid $1,200 on 2024-03-01 from ACC12345; Mr. Smith signed.", "Dr. Ling met Blue Corp and Blue Corp again; €900", "nothing here", "Ms. Roy: ACC0001, ACC77777, ACC0001 on 2023-12-31"])


def _entity_sql(patterns: dict[str, str], most: int = 10) -> str:
    one = lambda p: f"coalesce(array_to_string(list_slice(list_filter(m, lambda x, i: list_position(m, x) = i), 1, {most}), '|'), '')"  # noqa: E731, ARG005
    return ", ".join(f"(SELECT {one(p)} FROM (SELECT regexp_extract_all(t, '{p}') AS m)) AS {k}" for k, p in patterns.items())


@query(f"WITH t AS (SELECT o_orderkey, {EVIDENCE[1]} AS t FROM orders) SELECT o_orderkey, {_entity_sql(texts.ENTITIES)} FROM t")
def s_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Persons, companies, amounts, dates and accounts named in a piece of evidence."""
    return table(spark, sf, "orders").select("o_orderkey", *[F.concat_ws("|", c).alias(k) for k, c in texts.found(F.expr(EVIDENCE[0]), texts.ENTITIES).items()])


PAPERS = choice("o_orderkey", ["revenue 1,200.5 万元 up 12.5% since 2023/1/5, and 12.5% more", "loss of 300 USD and 300 USD, 7%", "none", "亿元 5亿元 on 2024-02-29 and 2024-2-9"])


@query(f"WITH t AS (SELECT o_orderkey, {PAPERS[1]} AS t FROM orders) SELECT o_orderkey, {_entity_sql(texts.KEY_INFO)} FROM t")
def s_key_info(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts, dates and ratios of a working paper, at most ten distinct ones of each."""
    return table(spark, sf, "orders").select("o_orderkey", *[F.concat_ws("|", c).alias(k) for k, c in texts.found(F.expr(PAPERS[0]), texts.KEY_INFO).items()])


MIXED = choice("o_orderkey", ["数据安全法 requires Audit 2024", "税 and 增值税", "plain words only", "审计报告, 审计"])


@query(f"""
WITH t AS (SELECT o_orderkey, {MIXED[1]} AS t FROM orders), r AS (SELECT o_orderkey, t, regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]+') AS r FROM t),
p AS (SELECT o_orderkey, t, flatten(list_transform(r, lambda x: CASE WHEN length(x) < 2 THEN [x] ELSE list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) END)) AS p FROM r)
SELECT o_orderkey, array_to_string(list_concat(coalesce(p, []), regexp_extract_all(lower(t), '[a-z0-9]+')), '|') AS tokens FROM p
""")
def s_tokens_zh(spark: SparkSession, sf: str) -> DataFrame:
    """Han bigrams and Latin words."""
    return table(spark, sf, "orders").select("o_orderkey", F.concat_ws("|", texts.tokens_zh(F.expr(MIXED[0]))).alias("tokens"))


@query(f"""
WITH t AS (SELECT o_orderkey, {MIXED[1]} AS t FROM orders), r AS (SELECT o_orderkey, t, regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}') AS r FROM t)
SELECT o_orderkey, array_to_string(CASE WHEN len(r) > 0 THEN r ELSE regexp_extract_all(t, '\\S') END, '|') AS tokens FROM r
""")
def s_tokens_run(spark: SparkSession, sf: str) -> DataFrame:
    """Han runs of two characters or more, else single characters."""
    return table(spark, sf, "orders").select("o_orderkey", F.concat_ws("|", texts.tokens_run(F.expr(MIXED[0]))).alias("tokens"))


def _stop_sql(code: str) -> str:
    words = ", ".join(f"'{w}'" for w in texts.STOP_WORDS[code])
    return f"len(list_filter(w, lambda x: x IN ({words}))) / greatest(len(w), 1)"


@query(f"""
WITH w AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM conversations),
s AS (SELECT conv_id, turn, {', '.join(f'{_stop_sql(c)} AS {c}' for c in texts.STOP_WORDS)}, len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')) / greatest(length(regexp_replace(text, '\\s', '', 'g')), 1) AS zh FROM w)
SELECT conv_id, turn, round(en, 6) AS en, round(fr, 6) AS fr, CASE WHEN greatest(zh, en, fr, de, es) = 0 THEN 'unknown' WHEN zh >= greatest(en, fr, de, es) THEN 'zh' WHEN en >= greatest(fr, de, es) THEN 'en' WHEN fr >= greatest(de, es) THEN 'fr' WHEN de >= es THEN 'de' ELSE 'es' END AS lang FROM s
""")
def s_lang_score(spark: SparkSession, sf: str) -> DataFrame:
    """The language with the largest share of Han letters or of its stop words."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", *[v.alias(k) for k, v in texts.language_scores(F.col("text")).items()])
    order = ["zh", "en", "fr", "de", "es"]
    best = F.greatest(*order)
    lang = F.when(best == 0, "unknown")
    for code in order:
        lang = lang.when(F.col(code) == best, code)
    return rows.select("conv_id", "turn", F.round("en", 6).alias("en"), F.round("fr", 6).alias("fr"), lang.alias("lang"))


@query(f"WITH t AS (SELECT o_orderkey, {MIXED[1]} AS t FROM orders) SELECT o_orderkey, regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}]') AND regexp_matches(t, '[A-Za-z]') AS switched FROM t")
def s_code_switch(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a text mixes scripts."""
    return table(spark, sf, "orders").select("o_orderkey", texts.code_switch(F.expr(MIXED[0])).alias("switched"))


TERMS = {"数据安全法": "data security law", "增值税": "VAT", "审计报告": "audit report", "审计": "audit"}


@query(f"""
WITH t AS (SELECT o_orderkey, {MIXED[1]} AS t FROM orders) SELECT o_orderkey, replace(replace(replace(replace(t, '数据安全法', 'data security law'), '审计报告', 'audit report'), '增值税', 'VAT'), '审计', 'audit') AS t FROM t
""")
def s_translate(spark: SparkSession, sf: str) -> DataFrame:
    """Terms replaced from a dictionary, longest first."""
    return table(spark, sf, "orders").select("o_orderkey", texts.dictionary(F.expr(MIXED[0]), TERMS).alias("t"))


GLOSSARY = {"red": "rouge", "small": "petit", "small ring": "petite bague", "widget": "gadget"}


@query("""
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(p_name), '(?i)\\bsmall ring\\b', 'petite bague', 'g'), '(?i)\\bwidget\\b', 'gadget', 'g'), '(?i)\\bsmall\\b', 'petit', 'g'), '(?i)\\bred\\b', 'rouge', 'g') AS name FROM part
""")
def s_term_translate(spark: SparkSession, sf: str) -> DataFrame:
    """A glossary applied longest first, whatever the case."""
    return table(spark, sf, "part").select("p_partkey", texts.glossary(F.upper("p_name"), GLOSSARY).alias("name"))


@query("""
WITH p AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (ORDER BY p_partkey) AS b FROM part), g AS (SELECT p_partkey, a, b, list_transform(range(1, greatest(length(a) - 2, 1) + 1), lambda i: substr(a, i, 3)) AS x, list_transform(range(1, greatest(length(b) - 2, 1) + 1), lambda i: substr(b, i, 3)) AS y FROM p WHERE b IS NOT NULL)
SELECT p_partkey, round(list_sum(list_transform(list_distinct(x), lambda t: least(len(list_filter(x, lambda u: u = t)), len(list_filter(y, lambda u: u = t))))) / greatest(len(x), len(y)), 6) AS similarity FROM g
""")
def s_ngram_sim(spark: SparkSession, sf: str) -> DataFrame:
    """Trigram similarity of neighbouring part names, counted as a multiset."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("a"))
    # the next key instead of an order over the whole table
    met = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")
    return met.select("p_partkey", F.round(texts.ngram_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("""
WITH c AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.;!?。；！？\\n]'), lambda x: trim(x, ' ')), lambda x: length(x) > 0) AS c FROM conversations)
SELECT conv_id, turn, round(coalesce(list_sum(list_transform(c, lambda x: length(x))) / nullif(len(c), 0), 0), 6) AS mean_length, round(coalesce(len(list_filter(c, lambda x: length(x) > 60)) / nullif(len(c), 0), 0), 6) AS long_share FROM c
""")
def s_readability(spark: SparkSession, sf: str) -> DataFrame:
    """Mean length of sentences and the share of long ones."""
    mean, share = texts.readability(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(mean, 6).alias("mean_length"), F.round(share, 6).alias("long_share"))


STATEMENTS = choice("o_orderkey", ["INSERT INTO mart.daily SELECT a.x FROM ods.trades a JOIN dim.party p ON a.k = p.k", "CREATE TABLE tmp.t AS SELECT * FROM ods.trades", "update ods.trades set x = 1", "select 1"])


@query(f"""
WITH t AS (SELECT o_orderkey, lower({STATEMENTS[1]}) AS t FROM orders)
SELECT o_orderkey, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\b(?:from|join) ([a-z_][\\w.]*)', 1))), '|'), '') AS reads, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\\b(?:insert into|insert overwrite|update|create table(?: if not exists)?) ([a-z_][\\w.]*)', 1))), '|'), '') AS writes FROM t
""")
def s_sql_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """The tables that a statement reads and writes."""
    reads, writes = checks.table_lineage(F.expr(STATEMENTS[0]))
    return table(spark, sf, "orders").select("o_orderkey", F.concat_ws("|", reads).alias("reads"), F.concat_ws("|", writes).alias("writes"))


SOURCES = choice("o_orderkey", ["def f(x): return x", "public class A { void f() {} }", "SELECT 1 FROM t", "const f = x => x", "10 PRINT"])


@query(f"""
WITH t AS (SELECT o_orderkey, {SOURCES[1]} AS t FROM orders) SELECT o_orderkey, CASE WHEN regexp_matches(t, 'def |import |self\\.') THEN 'python' WHEN regexp_matches(t, 'public class |System\\.out|void ') THEN 'java' WHEN regexp_matches(t, 'SELECT |INSERT |CREATE ') THEN 'sql' WHEN regexp_matches(t, 'function |const |=>') THEN 'javascript' ELSE 'unknown' END AS language FROM t
""")
def s_lang_code(spark: SparkSession, sf: str) -> DataFrame:
    """The language of a piece of source by its marks."""
    return table(spark, sf, "orders").select("o_orderkey", texts.code_language(F.expr(SOURCES[0])).alias("language"))


@query("""
WITH v AS (SELECT o_orderkey, o_orderkey % 9 AS a, o_orderkey % 5 AS b, o_orderkey % 3 AS c FROM orders)
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (a + 1)::VARCHAR || '.0.0' WHEN 1 THEN a::VARCHAR || '.' || (b + 1)::VARCHAR || '.0' ELSE a::VARCHAR || '.' || b::VARCHAR || '.' || (c + 1)::VARCHAR END AS version FROM v
""")
def s_bump_version(spark: SparkSession, sf: str) -> DataFrame:
    """The next major, minor or patch version."""
    key = F.col("o_orderkey")
    old = F.concat_ws(".", (key % 9).cast("string"), (key % 5).cast("string"), (key % 3).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", texts.bump(old, F.expr(choice("o_orderkey", ["major", "minor", "patch"])[0])).alias("version"))
