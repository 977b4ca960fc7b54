"""Operator 12: fill-in-middle documents, cut at ranked code-point offsets of a pre-tokenizer."""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: A token: a run of ASCII letters, or any other code point alone.
TOKEN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, those from PLAIN_FROM on stay as they are; of 100 others, those below SPM_BELOW have the suffix first.
PLAIN_FROM = 90
SPM_BELOW = 20
#: Code points given to the pre-tokenizer at once, up to the next end of a token.
PART = 1 << 15

_NO_LETTER = re.compile("[^A-Za-z]")


def token_cuts(text: str, split, one: int, two: int, part: int = PART) -> tuple[int, int, int]:
    """Tokens of a text, and the code points before the smaller and the larger of the ranks ``one`` and ``two`` modulo n + 1.

    The length of the pre-tokenizer's offsets gives n, the offsets at the ranks give the cuts. Long texts go to it in
    parts that end after a code point that is no letter: a token ends there in any case, so parts change nothing. Only
    the number of a part's tokens is kept; a part that holds a rank is split again, unless it is the last one.
    """
    parts, n, at, tokens = [], 0, 0, []
    while at < len(text):
        cut = _NO_LETTER.search(text, at + part - 1)
        end = cut.end() if cut else len(text)
        tokens = split.pre_tokenize_str(text[at:end])
        parts.append((n, at, end))
        n, at = n + len(tokens), end

    def offset(rank: int) -> int:
        if rank == n:
            return len(text)
        before, begin, end = parts[bisect_right(parts, rank, key=lambda p: p[0]) - 1]
        found = tokens if end == len(text) else split.pre_tokenize_str(text[begin:end])
        return begin + found[rank - before][1][0]

    first, last = sorted((one % (n + 1), two % (n + 1)))
    return n, offset(first), offset(last)


def cut_points(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """``token_cuts`` of each text."""
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(TOKEN), "isolated")
    out = np.zeros((3, len(texts)), np.int64)
    for i in range(len(texts)):
        out[:, i] = token_cuts(texts[i].as_py(), split, one[i].as_py(), two[i].as_py())
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "first", "last"])


def draws(key: str, seed: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers of a key, from the digest of ``seed``:key; a null key is the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "fim") -> DataFrame:
    """``df`` with a struct ``name``: n (tokens), form, prefix_chars, middle_chars and output.

    The text is cut at two drawn token ranks into prefix, middle and suffix. Form ``psm`` is marked prefix, suffix,
    middle; ``spm`` has the suffix first; ``plain`` texts stay whole and have null lengths: the empty text (null counts as
    empty), texts that hold a mark themselves, and a tenth by draw. Draws depend on the key alone, so rows of equal key
    and text get equal results and null keys share one draw. A column called ``name`` is replaced, all others stay as
    they are. No rows, no rows; texts of any length are cut whole.
    """
    points = F.arrow_udf(cut_points, "struct<n:bigint,first:bigint,last:bigint>")
    h1, h2, h3, h4 = draws(key)
    whole = text_of(F.col(text).cast("string"))
    row = df.withColumn(name, F.struct(whole.alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4")))
    part = lambda field: F.col(name)[field]
    row = row.withColumn(name, F.struct(part("text").alias("text"), part("h3").alias("h3"), part("h4").alias("h4"), points(part("text"), part("h1"), part("h2")).alias("cut")))
    body, first, last = part("text"), part("cut")["first"].cast("int"), part("cut")["last"].cast("int")
    marked = body.contains(PREFIX) | body.contains(SUFFIX) | body.contains(MIDDLE)
    form = F.when((body == "") | marked | (part("h3") % 100 >= PLAIN_FROM), "plain").when(part("h4") % 100 < SPM_BELOW, "spm").otherwise("psm")
    prefix, middle, suffix = F.substring(body, F.lit(1), first), F.substring(body, first + 1, last - first), F.substring(body, last + 1, F.length(body) - last)
    output = F.when(form == "plain", body).when(form == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    chars = lambda value: F.when(form != "plain", value.cast("long"))
    return row.withColumn(name, F.struct(part("cut")["n"].alias("n"), form.alias("form"), chars(first).alias("prefix_chars"), chars(last - first).alias("middle_chars"), output.alias("output")))


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone. The parts hold no mark and none arises at a seam, so the first counts."""
    second, rest = F.when(form == "spm", PREFIX).otherwise(SUFFIX), F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    one, two = F.split(rest, second, 2)[0], F.split(rest, second, 2)[1]
    two, middle = F.split(two, MIDDLE, 2)[0], F.split(two, MIDDLE, 2)[1]
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's fill-in-middle form, and of the text that is read back from it."""
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fim = out["fim"]
    return out.select("doc_id", fim.n.alias("n"), fim.form.alias("form"), fim.prefix_chars.alias("prefix_chars"), fim.middle_chars.alias("middle_chars"), F.sha2(fim.output, 256).alias("output_sha256"), F.sha2(restored(fim.output, fim.form), 256).alias("restored_sha256"))


OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS toks, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), r AS (
  SELECT doc_id, text, toks, len(toks) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(toks[1:lo], '') AS prefix, array_to_string(toks[lo + 1:hi], '') AS middle, array_to_string(toks[hi + 1:], '') AS suffix
  FROM r
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle ELSE '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle END AS output FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'spm' THEN split_part(split_part(output, '{PREFIX}', 2), '{MIDDLE}', 1) || split_part(output, '{MIDDLE}', 2) || split_part(substr(output, 4), '{PREFIX}', 1)
    ELSE split_part(substr(output, 4), '{SUFFIX}', 1) || split_part(output, '{MIDDLE}', 2) || split_part(split_part(output, '{SUFFIX}', 2), '{MIDDLE}', 1) END) AS restored_sha256
FROM o
"""
