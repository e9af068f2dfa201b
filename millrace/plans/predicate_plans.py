"""The remaining instruction predicates and text scorers over documents, some of them put into a form that a predicate asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions import sentences as S
from ..functions import text as T
from .base import Registry, table
from .text_plans import NORM

R = Registry()
WORDS = "regexp_extract_all(lower({t}),'[\\p{{L}}\\p{{N}}_]+')"
BLANKS = "list_filter(regexp_split_to_array(trim({t}),'\\s+'), lambda w: w<>'')"
DOTS = "chr(57344)"


def inner(build) -> str:
    """SQL with `{t}` for the text, whatever braces the rest has."""
    return build("\x00").replace("{", "{{").replace("}", "}}").replace("\x00", "{t}")


class Whole(str):
    """SQL that is complete: no `{t}` in it stands for the text."""


def marks_sql(t: str) -> str:
    """Sentences by marks. Dots beside dots are told pair by pair."""
    start = S.replaced_sql(f"(' '||{t}||'  ')", S.MARKED[:4]).replace("chr(57344)", DOTS)
    dots = f"replace(replace(replace(regexp_replace({start},'(\\.{{2,}})','\\1'||{DOTS},'g'),'..',chr(57345)||chr(57345)),chr(57345)||'.',chr(57345)||chr(57345)),chr(57345),'<prd>')"
    parts = f"list_transform(string_split({S.replaced_sql(f'replace({dots},{DOTS},' + chr(39) + '<stop>' + chr(39) + ')', S.MARKED[5:])},'<stop>'), lambda p: regexp_replace(p,'^\\s+|\\s+$','','g'))"
    return f"list_transform([{parts}], lambda p: CASE WHEN p[-1]='' THEN p[:len(p)-1] ELSE p END)[1]"


def tokens_sql(s: str) -> str:
    apart = S.replaced_sql(f"(' '||{S.replaced_sql(s, S.OPENING + S.PUNCTUATION)}||' ')", S.CLOSING)
    return f"list_filter(regexp_split_to_array({apart},'\\s+'), lambda w: w<>'')"


def among(words) -> str:
    return "(" + ",".join(f"'{w}'" for w in words) + ")"


def bare_sql(w: str) -> str:
    return f"regexp_replace({w},'^[\"''(\\[{{“‘«]+|[\"'')\\]}}”’»]+$','','g')"


ENDS = f"""regexp_matches(b,'[?!]$') OR (regexp_matches(b,'\\.$') AND CASE WHEN regexp_matches(b,'\\.\\.+$') OR regexp_matches(b,'^[0-9.,-]*[0-9]\\.$') THEN NOT regexp_matches(a,'^\\p{{Ll}}')
 WHEN regexp_matches(b,'^\\p{{L}}\\.$') THEN false WHEN lower(regexp_replace(b,'\\.$','')) IN {among(S.ABBREVIATIONS)} THEN regexp_matches(a,'^\\p{{Lu}}') AND lower(regexp_replace(a,'[.,;:!?]+$','')) IN {among(S.STARTERS)} ELSE true END)"""


def split_sql(shown: str) -> str:
    """(doc_id, i, sentence) of whole texts, with abbreviations, as `sent`."""
    return f"""SELECT doc_id, unnest(list_filter(string_split(string_agg(w||CASE WHEN a IS NULL THEN '' WHEN {ENDS} THEN {DOTS} ELSE ' ' END, '' ORDER BY i), {DOTS}), lambda s: s<>'')) AS s
FROM (SELECT doc_id, i, w, {bare_sql('w')} AS b, {bare_sql('lead(w) OVER (PARTITION BY doc_id ORDER BY i)')} AS a FROM
 (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws,1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array({shown},'\\s+'), lambda w: w<>'') AS ws FROM documents))) GROUP BY doc_id"""


def by_tokens(shown: str, holds: str) -> str:
    """`holds` of all tokens `ws` of a text."""
    return f"SELECT d.doc_id, coalesce({holds}, false) AS follows FROM documents d LEFT JOIN (SELECT doc_id, flatten(list({tokens_sql('s')})) AS ws FROM ({split_sql(shown)}) GROUP BY doc_id) USING (doc_id)"


MARKS = inner(marks_sql)
#: Profiles of languages from all documents that name theirs, and the language of each shown text.
GRAMS = "SELECT {key}, unnest(list_concat(cs, list_transform(range(1,len(cs)), lambda i: cs[i]||cs[i+1]), list_transform(range(1,len(cs)-1), lambda i: cs[i]||cs[i+1]||cs[i+2]))) AS gram FROM (SELECT {key}, string_split(' '||trim(regexp_replace(lower({text}),'[^\\p{{L}}]+',' ','g'))||' ','') AS cs FROM documents)"


def told_sql(shown: str) -> str:
    return f"""WITH learned AS (SELECT lang, gram, count(*) AS n FROM ({GRAMS.format(key='lang', text='text')}) WHERE gram<>' ' AND lang IS NOT NULL GROUP BY lang, gram QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram)<=1000),
odds AS (SELECT l.lang, g.gram, ln((coalesce(n,0)+0.5)/(total+500)) AS o FROM (SELECT lang, sum(n) AS total FROM learned GROUP BY 1) l CROSS JOIN (SELECT DISTINCT gram FROM learned) g LEFT JOIN learned USING (lang, gram)),
seen AS (SELECT doc_id, gram, count(*) AS times FROM ({GRAMS.format(key='doc_id', text=shown)}) GROUP BY ALL),
told AS (SELECT doc_id, arg_max(lang, s) AS lang FROM (SELECT doc_id, lang, sum(times*o) AS s FROM seen JOIN odds USING (gram) GROUP BY ALL) GROUP BY 1)
SELECT doc_id, {{holds}} AS follows FROM documents LEFT JOIN (SELECT doc_id, lang AS told FROM told) USING (doc_id)"""


def either(a: Column | str, b: Column | None = None) -> Column:
    """`a` before documents of odd ids, or another text; others are as they are."""
    return F.when(F.col("doc_id") % 2 == 1, a).otherwise(F.col("text") if b is None else b)


def before(start: str) -> Column:
    return either(F.concat(F.lit(start), F.col("text")))


def after(end: str) -> Column:
    return either(F.concat(F.col("text"), F.lit(end)))



def odd(sql: str) -> str:
    return f"(CASE WHEN doc_id%2=1 THEN {sql} ELSE text END)"


def parts_of(split: str, n: int) -> str:
    """In SQL: `n` parts that aren't blank, blank ones at the ends only."""
    filled = f"len(list_filter({split}, lambda p: regexp_matches(p,'\\S')))={n}"
    return f"coalesce({filled} AND len(list_filter(({split})[2:len({split})-1], lambda p: NOT regexp_matches(p,'\\S')))=0, false)"


STARS = "regexp_split_to_array({t},'\\s?\\*\\*\\*\\s?')"
NEXT = "string_split({t},e'\\n\\n')"
#: Letters of which several are made in capitals (ß is SS), as `upper` of Spark has them; that of DuckDB leaves them or takes one.
SEVERAL = {c: c.upper() for c in map(chr, range(0x10000)) if len(c.upper()) > 1}


def upper_sql(t: str) -> str:
    each = t
    for c, by in SEVERAL.items():
        each = f"replace({each},'{c}','{by}')"
    return f"upper(CASE WHEN regexp_matches({t},'[{''.join(SEVERAL)}]') THEN {each} ELSE {t} END)"


# key, predicate, parameters, the text that is checked, the same in SQL, and what follows from it in SQL
CASES = [
    ("if05_response_language", "language:response_language", {"language": "fr", "known": L.learned_profiles}, lambda: F.col("text"), "text", Whole(told_sql("text").replace("{holds}", "coalesce(told='fr', true)"))),
    ("if06_number_sentences", "length_constraints:number_sentences", {"relation": "at least", "n": 9}, lambda: before("Mr. Poe met Dr. Who at 5 p.m. They left. "), odd("'Mr. Poe met Dr. Who at 5 p.m. They left. '||text"), Whole(f"SELECT d.doc_id, coalesce(n,0)>=9 AS follows FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({split_sql(odd(chr(39) + 'Mr. Poe met Dr. Who at 5 p.m. They left. ' + chr(39) + '||text'))}) GROUP BY 1) USING (doc_id)")),
    ("if07_number_paragraphs", "length_constraints:number_paragraphs", {"n": 2}, lambda: before("a *** "), odd("'a *** '||text"), parts_of(STARS, 2)),
    ("if09_nth_paragraph_first_word", "length_constraints:nth_paragraph_first_word", {"paragraphs": 2, "nth": 2, "word": "well-known"}, lambda: either(F.concat(F.replace("text", F.lit("\n\n"), F.lit(" ")), F.lit("\n\n'Well-known, c"))), odd("replace(text,e'\\n\\n',' ')||e'\\n\\n''Well-known, c'"),
     f"len(list_filter({NEXT}, lambda p: regexp_matches(p,'\\S')))=2 AND coalesce(lower(regexp_extract(regexp_replace(regexp_extract(regexp_replace(({NEXT})[2],'^\\s+',''),'^\\S+'),'^''*\"*',''),'^[^.,?!''\"]*')),'')='well-known'"),
    ("if11_postscript", "detectable_content:postscript", {"marker": "P.P.S"}, lambda: after("\nP. P.S it"), odd("text||e'\\nP. P.S it'"), "regexp_matches(lower({t}),'p\\.\\s?p\\.\\s?s')"),
    ("if12_bullets", "detectable_format:number_bullet_lists", {"n": 2}, lambda: before("* a\n- b\n"), odd("e'* a\\n- b\\n'||text"), "len(regexp_extract_all({t},'(?m)^\\s*\\*[^\\*].*$'))+len(regexp_extract_all({t},'(?m)^\\s*-.*$'))=2"),
    ("if14_highlights", "detectable_format:number_highlighted_sections", {"n": 3}, lambda: before("*a* and **b** * * "), odd("'*a* and **b** * * '||text"), "len(list_filter(regexp_extract_all({t},'\\*[^\\n\\*]*\\*'), lambda h: regexp_matches(h,'[^\\s*]')))+len(list_filter(regexp_extract_all({t},'\\*\\*[^\\n\\*]*\\*\\*'), lambda h: regexp_matches(h,'[^\\s*]')))>=3"),
    ("if15_sections", "detectable_format:multiple_sections", {"splitter": "Section", "n": 2}, lambda: before("Section 1 a Section 2 b "), odd("'Section 1 a Section 2 b '||text"), "len(regexp_extract_all({t},'\\s?Section\\s?[0-9]+\\s?'))>=2"),
    ("if16_json", "detectable_format:json_format", {}, lambda: either(F.concat(F.lit("```json\n"), F.to_json(F.struct("doc_id", "text")), F.lit("\n```")), F.concat(F.lit("{"), F.col("text"))), "text", "doc_id%2=1 OR ({t} IS NULL AND NULL)"),
    ("if17_title", "detectable_format:title", {}, lambda: before("<<a>> "), odd("'<<a>> '||text"), "regexp_matches({t},'<<[^\\n]*[^\\s<>][^\\n]*>>')"),
    ("if18_two_responses", "combination:two_responses", {}, lambda: after("******b"), odd("text||'******b'"), parts_of("string_split({t},'******')", 2) + " AND regexp_replace(string_split({t},'******')[1],'^\\s+|\\s+$','','g')<>'b'"),
    ("if19_repeat_prompt", "combination:repeat_prompt", {"prompt": "Say it. "}, lambda: before("\n say IT. "), odd("e'\\n say IT. '||text"), "starts_with(lower(regexp_replace({t},'^\\s+','')),'say it.')"),
    ("if21_capital_words", "change_case:capital_word_frequency", {"relation": "at least", "n": 2}, lambda: F.col("text"), "text", Whole(by_tokens("text", "len(list_filter(ws, lambda w: w=upper(w) AND w<>lower(w)))>=2"))),
    ("if22_capital", "change_case:english_capital", {"known": L.learned_profiles}, lambda: either(F.upper("text")), odd("upper(text)"), Whole(told_sql(odd(upper_sql("text"))).replace("{holds}", f"coalesce(told='en', true) AND {odd(upper_sql('text'))}={upper_sql('text')} AND {upper_sql('text')}<>lower(text)"))),
    ("if23_lowercase", "change_case:english_lowercase", {"known": L.learned_profiles}, lambda: either(F.lower("text")), odd("lower(text)"), Whole(told_sql(odd("lower(text)")).replace("{holds}", f"coalesce(told='en', true) AND {odd('lower(text)')}=lower(text) AND upper(text)<>lower(text)"))),
    ("if25_quotation", "startend:quotation", {}, lambda: either(F.concat(F.lit('"'), F.col("text"), F.lit('"\n'))), odd("'\"'||text||e'\"\\n'"), "regexp_matches({t},'(?s)^\\s*\".*\"\\s*$') AND length(regexp_replace({t},'^\\s+|\\s+$','','g'))>1"),
    ("if26_repeat_phrase", "copy:repeat_phrase", {"phrase": "zzq left zzk", "n": 1}, lambda: after(" zzq right zzk"), odd("text||' zzq right zzk'"), "coalesce(len(regexp_extract_all({t},'zzq .*? zzk'))=1 AND len(string_split(regexp_extract_all({t},'zzq .*? zzk')[1],' '))=3 AND regexp_extract_all({t},'zzq .*? zzk')[1]<>'zzq left zzk',false)"),
    ("if27_copy", "copy:copy", {"prompt": F.col}, lambda: either(F.concat(F.lit("\n"), F.col("text"), F.lit("\t")), F.concat(F.col("text"), F.lit("."))), "text", "{t} IS NOT NULL AND doc_id%2=1 OR ({t} IS NULL AND NULL)"),
    ("if28_copy_span", "new:copy_span_idx", {"prompt": "one two three", "start": 4, "end": 7}, lambda: either(F.lit(" TWO\n")), odd("e' TWO\\n'"), "lower(regexp_replace({t},'^\\s+|\\s+$','','g'))='two'"),
    ("if29_sentence_hyphens", "detectable_format:sentence_hyphens", {}, lambda: either(F.concat_ws("-", S.marked_sentences(F.replace("text", F.lit("-"), F.lit(" "))))), "text",
     Whole(f"SELECT doc_id, len(list_filter(range(1,1+least(len(p),len(g))), lambda i: p[i]<>g[i] OR regexp_matches(p[i],'^\\s|\\s$')))=0 AS follows FROM (SELECT doc_id, string_split(t,'-') AS p, {marks_sql(chr(39).join(['replace(t,', '-', ',', ' ', ')']))} AS g FROM (SELECT doc_id, CASE WHEN doc_id%2=1 THEN array_to_string({marks_sql(chr(39).join(['replace(text,', '-', ',', ' ', ')']))},'-') ELSE text END AS t FROM documents))")),
    ("if30_no_adjacent_letters", "keywords:no_adjacent_consecutive", {}, lambda: either(F.lit("alpha zeta beta")), odd("'alpha zeta beta'"), f"SELECT doc_id, len(list_filter(range(1,len(w)), lambda i: ascii(lower(w[i+1]))-ascii(lower(w[i]))=1))=0 AS follows FROM (SELECT doc_id, {BLANKS} AS w FROM documents)"),
    ("if31_square_brackets", "detectable_format:square_brackets", {}, lambda: either(F.concat(F.lit("["), F.regexp_replace(T.trimmed(F.col("text")), r"\s+", "] ["), F.lit("]"))), odd("'['||regexp_replace(regexp_replace(text,'^\\s+|\\s+$','','g'),'\\s+','] [','g')||']'"), f"len(list_filter({BLANKS}, lambda w: NOT (w LIKE '[%]')))=0"),
    ("if33_word_count", "keywords:word_count_different_numbers", {"keyword": "an", "relation": "less than", "n": 4}, lambda: F.col("text"), "text", "len(regexp_extract_all(lower({t}),'an'))<4"),
    ("if35_paragraphs", "paragraphs:paragraphs", {}, lambda: after(" *** b"), odd("text||' *** b'"), parts_of(STARS, 2)),
    ("if36_paragraphs2", "paragraphs:paragraphs2", {}, lambda: after("\n\nb\n\n"), odd("text||e'\\n\\nb\\n\\n'"), parts_of(NEXT, 2)),
    ("if37_first_word_sent", "first_word:first_word_sent", {"word": "so"}, lambda: either(F.lit("So a. so b!"), F.concat(F.lit("So, "), F.col("text"))), "(CASE WHEN doc_id%2=1 THEN 'So a. so b!' ELSE 'So, '||text END)", f"len(list_filter({MARKS}, lambda s: lower(regexp_extract(s,'^\\S+'))<>'so'))=0"),
    ("if39_last_word_sent", "last_word:last_word_sent", {"word": "wellknown"}, lambda: either(F.lit("It is well-known. A (well-known)!")), odd("'It is well-known. A (well-known)!'"), f"len(list_filter({MARKS}, lambda s: lower(regexp_replace(regexp_extract(s,'\\S+$'),'[^\\p{{{{L}}}}\\p{{{{N}}}}_\\s]','','g'))<>'wellknown'))=0"),
    ("if40_last_word", "last_word:last_word_answer", {"word": "End"}, lambda: after(" to the end!"), odd("text||' to the end!'"), f"coalesce(regexp_replace(lower(({BLANKS})[-1]),'[^\\p{{{{L}}}}\\p{{{{N}}}}_\\s]','','g')='end',false)"),
    ("if41_bigram_wrapping", "detectable_format:bigram_wrapping", {}, lambda: either(F.concat(F.lit("<<a b>> <<c d>> "), F.regexp_extract(F.col("text"), r"^\S+", 0))), odd("'<<a b>> <<c d>> '||regexp_extract(text,'^\\S+')"), f"SELECT doc_id, len(list_filter(range(1,len(w),2), lambda i: NOT (w[i] LIKE '<<%' AND w[i+1] LIKE '%>>')))=0 AS follows FROM (SELECT doc_id, {BLANKS} AS w FROM documents)"),
    ("if42_copying_simple", "copy:copying_simple", {"prompt": F.col}, lambda: either(F.col("text"), F.concat(F.col("text"), F.lit("."))), "text", "{t} IS NOT NULL AND doc_id%2=1 OR ({t} IS NULL AND NULL)"),
    ("if43_copying_multiple", "copy:copying_multiple", {"prompt": F.col, "n": 3}, lambda: either(F.concat(F.col("text"), F.lit(" ****** "), F.col("text"), F.lit(" ******\n"), F.col("text"))), "text", "{t} IS NOT NULL AND doc_id%2=1 OR ({t} IS NULL AND NULL)"),
    ("if48_letter_counting", "letters:letter_counting2", {"letter": "a", "relation": "at least", "n": 30}, lambda: F.col("text"), "text", "length({t})-length(replace(lower({t}),'a',''))>=30"),
    ("if49_composition", "count:counting_composition", {"n_sent": 2, "n_words": 3}, lambda: either(F.lit("aa bb. cc dd.***ee ff. gg hh.*** ii jj. kk ll!")), odd("'aa bb. cc dd.***ee ff. gg hh.*** ii jj. kk ll!'"), f"len({STARS})=3 AND len(list_filter({STARS}, lambda p: len({inner(lambda t: marks_sql('p'))})<>2 OR len(list_filter({inner(lambda t: marks_sql('p'))}, lambda s: len({inner(lambda t: tokens_sql('s'))})<>3))>0))=0"),
    ("if50_count_unique", "count:count_unique", {}, lambda: either(S.first_words(F.col("text"), 6)), "text", Whole(by_tokens("(CASE WHEN doc_id%2=1 THEN array_to_string(list_filter(regexp_split_to_array(trim(text),'\\s+'), lambda w: w<>'')[1:6],' ') ELSE text END)", "len(ws)=len(list_distinct(ws))"))),
    ("if51_increment_word", "count:count_increment_word", {"keyword1": "zzq", "keyword2": "zzk"}, lambda: after(" zzq ZZK zzk"), odd("text||' zzq ZZK zzk'"), "len(regexp_extract_all(lower({t}),'zzq'))=1 AND len(regexp_extract_all(lower({t}),'zzk'))=2"),
    ("if52_palindrome", "keywords:palindrome", {}, lambda: F.col("text"), "text", f"len(list_filter({BLANKS}, lambda w: w=reverse(w)))>0"),
    ("if53_keyword_position", "keywords:keyword_specific_position", {"keyword": "Key", "n": 2, "m": 5}, lambda: before("Mr. Poe isn't big. \"So they\" Key. "), "text", Whole(f"SELECT doc_id, coalesce(({tokens_sql('s')})[5]='Key',false) AS follows FROM (SELECT doc_id, ({marks_sql(odd(chr(39) + 'Mr. Poe isn' + chr(39) * 2 + 't big. ' + chr(34) + 'So they' + chr(34) + ' Key. ' + chr(39) + '||text'))})[2] AS s FROM documents)")),
    ("if54_start_end", "keywords:start_end", {}, lambda: either(F.concat(F.lit("so "), F.col("text"), F.lit(" So"))), odd("'so '||text||' So'"), Whole(by_tokens(odd("'so '||text||' So'"), "len(ws)>1 AND lower(ws[1])=lower(ws[-1])"))),
]


def predicate(name, how, checked):
    def query(spark, sf):
        texts = table(spark, sf, "documents")
        given = {k: F.col("text") if v is F.col else v(texts) if v is L.learned_profiles else F.lit(v) if k == "prompt" and name.startswith("combination") else v for k, v in how.items()}
        return texts.select("doc_id", T.PREDICATES[name](checked(), **given).alias("follows"))

    return query


for key, name, how, checked, shown, sql in CASES:
    query = predicate(name, how, checked)
    query.__name__ = key
    sql = str(sql) if isinstance(sql, Whole) else sql.format(t=shown)
    R.add(sql if sql.startswith(("SELECT", "WITH")) else f"SELECT doc_id, {sql} AS follows FROM documents")(query)


def docs(spark, sf):
    return table(spark, sf, "documents")


def with_next(spark, sf):
    """Documents with the text of the next one."""
    d = docs(spark, sf).select("doc_id", "text")
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")


NEXT_ONE = "n AS (SELECT d.doc_id, d.text, e.text AS other FROM documents d JOIN documents e ON e.doc_id=d.doc_id+1)"


@R.add(f"WITH {NEXT_ONE} SELECT doc_id, {NORM.format('other')}={NORM.format(odd('text'))} OR {NORM.format('text')}={NORM.format(odd('text'))} AS matches FROM n".replace("ELSE text END", "ELSE text||' the same' END"))
def tx3_exact_match(spark, sf):
    """Whole texts against the next document and themselves with an article and marks; those of even ids have two words more."""
    said = F.concat(F.lit("The "), either(F.col("text"), F.concat(F.col("text"), F.lit(" the same"))), F.lit("!"))
    return with_next(spark, sf).select("doc_id", T.exact_match(said, F.array("other", F.concat(F.lit("an "), "text", F.lit(" ?!")))).alias("matches"))


@R.add("SELECT doc_id, CASE WHEN doc_id%2=1 THEN source END AS answer FROM documents")
def tx5_last_answer(spark, sf):
    last = F.concat(F.lit("<answer>x</answer>\n<answer> "), F.col("source"), F.lit(" </answer>"))
    return docs(spark, sf).select("doc_id", T.last_answer(either(last, F.lit("<answer>x</answer>"))).alias("answer"))


@R.add("SELECT doc_id, [source, 'b'] AS blocks FROM documents WHERE source IS NOT NULL")
def tx6_information_blocks(spark, sf):
    t = F.concat(F.lit("<information> "), F.col("source"), F.lit("</information> <information>b\n</information>"))
    return docs(spark, sf).filter("source IS NOT NULL").select("doc_id", F.transform(T.information_blocks(t), T.trimmed).alias("blocks"))


MIDDLE = "array_to_string(list_filter(regexp_split_to_array({t},'\\s+'), lambda w: w<>'')[3:6],' ')"


@R.add(f"WITH {NEXT_ONE} SELECT doc_id, contains({NORM.format('text')}, {NORM.format(MIDDLE.format(t='other'))}) OR contains({NORM.format('text')}, {NORM.format(odd(MIDDLE.format(t='text'))).replace('ELSE text END', 'ELSE source_of END')}) AS found FROM (SELECT *, 'no such answer' AS source_of FROM n)")
def tx7_retrieved(spark, sf):
    """Four words from the middle of the next document, and of the text itself where ids are odd, in the whole text as retrieved."""
    four = lambda c: F.array_join(F.slice(T.words(F.regexp_replace(c, r"\s+", " ")), 3, 4), " ")
    golds = F.array(four("other"), either(four("text"), F.lit("no such answer")))
    return with_next(spark, sf).select("doc_id", T.retrieved(F.concat(F.lit("<information>"), F.col("text"), F.lit("</information>")), golds).alias("found"))


@R.add(
    """WITH t AS (SELECT doc_id, contains(text,' the ') AS right_, NOT contains(text,'!') AS formed, contains(text,'ing') AS seen, contains(text,'.') AS given FROM documents)
SELECT doc_id, round((CASE WHEN right_ AND formed THEN 1.0 WHEN right_ THEN 0.8 WHEN formed THEN CASE WHEN seen THEN 0.3 ELSE 0.2 END WHEN given THEN 0.1 ELSE 0.0 END)::DOUBLE,6) AS score FROM t"""
)
def tx8_score_ladder(spark, sf):
    """What whole texts hold stands for being right, well formed, retrieved and answered."""
    holds = lambda what: F.contains("text", F.lit(what))
    score = T.structured_score(holds(" the "), ~holds("!"), holds("ing"), holds("."), 0.2, 0.1, 0.1)
    return docs(spark, sf).select("doc_id", F.round(score, 6).alias("score"))


@R.add("SELECT doc_id, md5(regexp_replace(text,'^\\s+|\\s+$','','g')) AS rest FROM documents")
def tx9_without_reasoning(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.without_reasoning(F.concat(F.lit("a</think>b</think> "), F.col("text")))).alias("rest"))


@R.add(
    """WITH t AS (SELECT doc_id, text||CASE length(text)%4 WHEN 0 THEN ' the Answer is ('||l||')' WHEN 1 THEN ' so ('||l||')' WHEN 2 THEN ' B or '||l ELSE '' END AS t FROM (SELECT *, substr('ABCD', (length(text)//4%4+1)::INT, 1) AS l FROM documents))
SELECT doc_id, coalesce(nullif(upper(regexp_extract(t,'(?i)answer\\s*(?:is|:)?\\s*\\(?([ABCD])\\b',1)),''), nullif(regexp_extract(t,'\\(([ABCD])\\)',1),''), regexp_extract_all(t,'\\b([ABCD])\\b',1)[-1]) AS letter FROM t"""
)
def tx10_choice_letter(spark, sf):
    """Whole texts with an answer behind them, told in one of three ways or not at all; where and which follows from the length."""
    n = F.length("text")
    letter = F.substring(F.lit("ABCD"), (F.floor(n / 4) % 4 + 1).cast("int"), F.lit(1))
    tail = F.when(n % 4 == 0, F.concat(F.lit(" the Answer is ("), letter, F.lit(")"))).when(n % 4 == 1, F.concat(F.lit(" so ("), letter, F.lit(")"))).when(n % 4 == 2, F.concat(F.lit(" B or "), letter)).otherwise(F.lit(""))
    return docs(spark, sf).select("doc_id", T.choice_letter(F.concat("text", tail)).alias("letter"))


@R.add("SELECT doc_id, CASE WHEN length(text)%3<>1 THEN md5(translate(text,'{}','()')||'{x}') END AS held FROM documents")
def tx13_unwrapped_box(spark, sf):
    """Whole texts in a box that holds another pair of braces; in every third the box is of the other kind."""
    from ..functions.math_answers import boxed_column

    kind = F.when(F.length("text") % 3 == 1, r"\fbox{").otherwise(r"\boxed{")
    return docs(spark, sf).select("doc_id", F.md5(boxed_column(F.concat(F.lit("so "), kind, F.translate("text", "{}", "()"), F.lit("{x}} it is")))).alias("held"))


@R.add("SELECT doc_id, md5(lower(trim(regexp_replace(text,'\\s+',' ','g')))) AS collapsed FROM documents")
def tx25_collapsed(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(T.collapsed(F.col("text"))).alias("collapsed"))


@R.add("SELECT doc_id, 'x = '||doc_id AS code FROM documents")
def tx31_fenced_python(spark, sf):
    t = F.concat(F.lit("```py\nno\n``` then\n```python\n x = "), F.col("doc_id").cast("string"), F.lit(" \n```"))
    return docs(spark, sf).select("doc_id", T.fenced_python(t).alias("code"))


LOOSE = "(regexp_matches({v},'\\S') AND NOT contains({v},','))"


@R.add(
    f"""WITH t AS (SELECT doc_id, CASE WHEN length(text)%2=1 THEN e'Well, so:\\n'||replace(text,',','') ELSE text END AS t FROM documents), l AS (SELECT doc_id, t, string_split(t,e'\\n') AS p FROM t),
v AS (SELECT doc_id, unnest([t, array_to_string(p[2:],e'\\n'), array_to_string(p[:len(p)-1],e'\\n'), array_to_string(p[2:len(p)-1],e'\\n')]) AS v FROM l)
SELECT doc_id, bool_or({LOOSE.format(v="v")} OR {LOOSE.format(v="replace(v,'*','')")}) AS loose FROM v GROUP BY 1"""
)
def tx37_loose_following(spark, sf):
    """Whole texts without commas: half of them lose theirs but for a line before."""
    t = F.when(F.length("text") % 2 == 1, F.concat(F.lit("Well, so:\n"), F.replace("text", F.lit(","), F.lit("")))).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", T.follows_loosely(t, [("punctuation:no_comma", {})]).alias("loose"))
