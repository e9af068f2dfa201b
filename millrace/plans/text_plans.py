"""Text scorers and instruction predicates over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.scores import token_f1_rows
from .base import Registry, r6, table

R = Registry()
NORM = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({0}),'[!-/:-@\\[-`{{-~]','','g'),'\\s+'), lambda w: w NOT IN ('','a','an','the')),' ')"


def docs(spark, sf):
    return table(spark, sf, "documents")


@R.add(f"SELECT doc_id, md5({NORM.format('text')}) AS answer FROM documents")
def tx1_normalized_answer(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.normalize_answer(F.col("text"))).alias("answer"))


@R.add(
    f"""WITH h AS (SELECT d.doc_id, {NORM.format('d.text')} AS p, {NORM.format('e.text')} AS g FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1),
a AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split(p,' ')) AS w FROM h) WHERE w<>'' GROUP BY ALL), b AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split(g,' ')) AS w FROM h) WHERE w<>'' GROUP BY ALL),
s AS (SELECT a.doc_id, sum(least(a.n,b.n)) AS same FROM a JOIN b ON a.doc_id=b.doc_id AND a.w=b.w GROUP BY 1), na AS (SELECT doc_id, sum(n) AS n FROM a GROUP BY 1), nb AS (SELECT doc_id, sum(n) AS n FROM b GROUP BY 1)
SELECT h.doc_id, round(CASE WHEN p<>g AND (p IN ('yes','no','noanswer') OR g IN ('yes','no','noanswer')) OR same IS NULL THEN 0.0 ELSE 2.0*same/(na.n+nb.n) END,6) AS f1, round(CASE WHEN p<>g AND (p IN ('yes','no','noanswer') OR g IN ('yes','no','noanswer')) OR same IS NULL THEN 0.0 ELSE same/na.n END,6) AS precision, round(CASE WHEN p<>g AND (p IN ('yes','no','noanswer') OR g IN ('yes','no','noanswer')) OR same IS NULL THEN 0.0 ELSE same/nb.n END,6) AS recall FROM h LEFT JOIN s USING (doc_id) LEFT JOIN na USING (doc_id) LEFT JOIN nb USING (doc_id)"""
)
def tx2_token_f1(spark, sf):
    """Each document against the next one, whole texts."""
    d = docs(spark, sf)
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("gold"))
    return token_f1_rows(d.join(after, "doc_id"), "doc_id", "text", "gold").select("doc_id", *[r6(F.col(c), c) for c in ("f1", "precision", "recall")])


@R.add("SELECT doc_id, sha256(lower(trim(regexp_replace(text,'\\s+',' ','g')))) AS hash FROM documents")
def tx26_prompt_hash(spark, sf):
    return docs(spark, sf).select("doc_id", T.prompt_hash(F.col("text")).alias("hash"))


@R.add("SELECT doc_id, md5(regexp_replace(lower(text),'[^\\p{L}\\p{N}]','','g')) AS fingerprint FROM documents")
def tx24_fingerprint(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.fingerprint(F.col("text"))).alias("fingerprint"))


@R.add("SELECT source_name, count(*) AS n FROM (SELECT CASE WHEN source='' THEN 'unknown' ELSE regexp_replace(coalesce(source,'unknown'),'[^A-Za-z0-9_.-]+','_','g') END AS source_name FROM documents) GROUP BY 1")
def pf11_source_labels(spark, sf):
    return docs(spark, sf).groupBy(T.source_label(F.col("source")).alias("source_name")).agg(F.count("*").alias("n"))


CASES = [
    ("if01_existence", "keywords:existence", {"keywords": ["the", "of"]}, "contains(lower(text),'the') AND contains(lower(text),'of')"),
    ("if02_frequency", "keywords:frequency", {"keyword": "the", "relation": "at least", "n": 5}, "len(regexp_extract_all(lower(text),'the'))>=5"),
    ("if03_forbidden", "keywords:forbidden_words", {"words": ["idiot", "clown"]}, "NOT regexp_matches(text,'(?i)\\b(idiot|clown)\\b')"),
    ("if04_letter_frequency", "keywords:letter_frequency", {"letter": "e", "relation": "at least", "n": 50}, "length(text)-length(replace(lower(text),'e',''))>=50"),
    ("if08_number_words", "length_constraints:number_words", {"relation": "less than", "n": 200}, "len(regexp_extract_all(text,'[\\p{L}\\p{N}_]+'))<200"),
    ("if10_placeholders", "detectable_content:number_placeholders", {"n": 1}, "len(regexp_extract_all(text,'\\[.*?\\]'))>=1"),
    ("if13_constrained", "detectable_format:constrained_response", {"options": ["License", "rights"]}, "contains(text,'License') OR contains(text,'rights')"),
    ("if20_end", "startend:end_checker", {"phrase": "The."}, "ends_with(lower(trim(regexp_replace(text,'^\\s+|\\s+$','','g'),'\"')),'the.')"),
    ("if24_no_comma", "punctuation:no_comma", {}, "NOT contains(text,',')"),
    ("if44_no_dot", "punctuation:punctuation_dot", {}, "NOT contains(text,'.')"),
    ("if45_no_exclamation", "punctuation:punctuation_exclamation", {}, "NOT contains(text,'!')"),
    ("if32_word_once", "keywords:word_once", {"keyword": "license"}, "len(regexp_extract_all(lower(text),'license'))=1"),
    ("if34_exclude_word", "keywords:exclude_word_harder", {"keyword": "that"}, "NOT contains(text,' that ')"),
    ("if46_lowercase_count", "count:lowercase_counting", {"n": 100}, "len(list_filter(regexp_extract_all(text,'[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w,'[a-z]+')))<=100"),
    ("if47_letter_count", "letters:letter_counting", {"relation": "at least", "n": 1000}, "len(regexp_extract_all(text,'[a-zA-Z]'))>=1000"),
    ("if38_first_word", "first_word:first_word_answer", {"word": "the"}, "lower(regexp_extract(trim(text),'^\\S+'))='the'"),
]


def predicate(name: str, how: dict):
    def query(spark, sf):
        return docs(spark, sf).select("doc_id", T.PREDICATES[name](F.col("text"), **how).alias("follows"))

    return query


for key, name, how, sql in CASES:
    query = predicate(name, how)
    query.__name__ = key
    R.add(sql and f"SELECT doc_id, {sql} AS follows FROM documents")(query)


@R.add("SELECT doc_id, NOT contains(text,',') AND length(text)-length(replace(lower(text),'e',''))>=5 AND trim(text)<>'' AS strict FROM documents")
def tx36_strict_following(spark, sf):
    asked = [("punctuation:no_comma", {}), ("keywords:letter_frequency", {"letter": "e", "relation": "at least", "n": 5})]
    return docs(spark, sf).select("doc_id", T.follows_strictly(F.col("text"), asked).alias("strict"))


@R.add("WITH f AS (SELECT DISTINCT item_id, lower(trim(regexp_replace(text,'\\s+',' ','g'))) AS t FROM benchmark) SELECT doc_id, list_sort(list(item_id)) AS items FROM documents JOIN f ON contains(lower(trim(regexp_replace(text,'\\s+',' ','g'))), t) GROUP BY 1")
def jn3_contained_items(spark, sf):
    from ..operators.containment import contained_items

    d = docs(spark, sf).select("doc_id", T.collapsed(F.col("text")).alias("text"))
    b = table(spark, sf, "benchmark").select("item_id", T.collapsed(F.col("text")).alias("text"))
    return contained_items(d, b).groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
