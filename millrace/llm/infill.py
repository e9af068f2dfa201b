"""Fill-in-middle examples by escaped marker injection, in DataFrame functions only.

Each text is cut into lines. A delimiter that can't occur in the text any more, since it was escaped before, is put behind every
line by one replacement; how often it stands there is the number of lines, and what lies before its k-th place are the first
k lines. Two cut points, drawn from a hash of the id, give prefix, middle and suffix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: The delimiter behind each unit, and the character that announces an escaped one.
MARK, ESCAPE = "\x1e", "\x1b"
#: A unit is a line with its end, or the rest of the text.
UNIT = "[^\\n]+\\n?|\\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(MARK), F.lit(ESCAPE + "1"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit(MARK)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def marked(text: Column, unit: str = UNIT) -> Column:
    """The escaped text with the delimiter behind every unit."""
    return F.regexp_replace(escaped(text), f"({unit})", "$1" + MARK)


def times(text: Column, what: str) -> Column:
    """How often the single character `what` stands in the text."""
    return (F.length(text) - F.length(F.translate(text, what, ""))).cast("bigint")


def first_units(text: Column, count: Column) -> Column:
    """The first `count` units of a marked text, still escaped and marked."""
    return F.call_function("substring_index", text, F.lit(MARK), count.cast("int"))


def plain(text: Column) -> Column:
    """Units of a marked text as they were."""
    return unescaped(F.translate(text, MARK, ""))


def drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and id; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text of an output. A marker begins with a character that stands nowhere else in it, so none can come about where a part
    meets a marker, and the first place of each is the one that was put there."""
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    psm_prefix = F.substring_index(body, SUFFIX, 1)
    psm_rest = F.substring(body, F.length(psm_prefix) + len(SUFFIX) + 1, F.length(body))
    psm_suffix = F.substring_index(psm_rest, MIDDLE, 1)
    psm_middle = F.substring(psm_rest, F.length(psm_suffix) + len(MIDDLE) + 1, F.length(psm_rest))
    spm_suffix = F.substring_index(body, PREFIX, 1)
    spm_rest = F.substring(body, F.length(spm_suffix) + len(PREFIX) + 1, F.length(body))
    spm_prefix = F.substring_index(spm_rest, MIDDLE, 1)
    spm_middle = F.substring(spm_rest, F.length(spm_prefix) + len(MIDDLE) + 1, F.length(spm_rest))
    return F.when(form == "psm", F.concat(psm_prefix, psm_middle, psm_suffix)).when(form == "spm", F.concat(spm_prefix, spm_middle, spm_suffix)).otherwise(output)


def infilled(docs: DataFrame, rate: int = 100, spm_rate: int = 50, seed: int = 7) -> DataFrame:
    """Each row of `docs` (doc_id, text) with n (its units), form (plain, psm or spm), prefix, middle and suffix (null if plain) and output.

    `rate` of 100 texts are cut, `spm_rate` of 100 of those put the suffix first. A text is plain if it is empty or holds a
    marker, whatever was drawn. A null text is empty, a null doc_id draws as an empty one, and repeated rows are cut alike. A
    part may be empty, where both cuts fall together or on an end. Long texts are handled whole; an empty table gives an
    empty one. Only doc_id and text are read, further columns go."""
    h1, h2, h3, h4 = drawn(F.col("doc_id"), seed)
    text = F.coalesce("text", F.lit(""))
    holds = text == ""
    for m in MARKERS:
        holds = holds | F.contains(text, F.lit(m))
    units = docs.select("doc_id", text.alias("text"), marked(text).alias("marked"), h1.alias("h1"), h2.alias("h2"), (holds | (h3 % 100 >= rate)).alias("whole"), h4.alias("h4"))
    units = units.withColumn("n", times(F.col("marked"), MARK))
    low, high = [f(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)) for f in (F.least, F.greatest)]
    form = F.when(F.col("whole"), "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    cut = units.select("doc_id", "text", "marked", "n", form.alias("form"), first_units(F.col("marked"), high).alias("head"), low.alias("low"))
    cut = cut.select("doc_id", "text", "n", "form", "marked", "head", first_units(F.col("head"), F.col("low")).alias("start"))
    # `head` has no delimiter behind its last unit unless it is the whole text, and the same holds for `start` within it.
    after = lambda whole, part: F.substring(F.col(whole), F.length(part) + 1, F.length(whole))
    only = lambda c, name: F.when(F.col("form") != "plain", plain(c)).alias(name)
    parts = cut.select("doc_id", "text", "n", "form", only(F.col("start"), "prefix"), only(after("head", "start"), "middle"), only(after("marked", "head"), "suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"))


def infilled_documents(docs: DataFrame) -> DataFrame:
    """Lengths and digests of `infilled`: doc_id, n, form, prefix_chars, middle_chars (null if plain), output_sha256, and
    restored_sha256 of the text that is rebuilt from output and form alone."""
    return infilled(docs).select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("bigint").alias("prefix_chars"),
        F.length("middle").cast("bigint").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


INFILL_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || digest[1:8])::BIGINT % (len(units) + 1) AS a,
         ('0x' || digest[9:16])::BIGINT % (len(units) + 1) AS b, ('0x' || digest[17:24])::BIGINT AS h3, ('0x' || digest[25:32])::BIGINT AS h4
  FROM cut
), parts AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(units[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(units[least(a, b) + 1:greatest(a, b)], ''), '') AS m,
         coalesce(array_to_string(units[greatest(a, b) + 1:], ''), '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
