"""Fill-in-middle forms of texts: a text is cut into lines, and prefix, middle and suffix change places.

``regexp_count`` gives the number of lines n.  Two cut points drawn from a keyed digest of the id make a pattern of the
row's own, ``(line{a})(line{b-a})(rest)`` with possessive counts, and one match of it both captures the three parts and
writes them in their new order.  Possessive counts neither recurse nor step back, so a text of millions of lines takes one
pass.  Everything is a column expression: no shuffle, no state, one row in and one row out.

Markers stand once each in a result: a text that holds one of them stays plain, and markers that could overlap are
refused, so that the text can be rebuilt from the result and its form alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line with its ending mark, or the last line without one.  Possessive, so that a long line is read once.
LINE = r"(?:[^\n]*+\n|[^\n]++)"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Markers:
    """What stands ahead of the three parts."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        for i, a in enumerate(marks):
            for j, b in enumerate(marks):
                if not a or (i != j and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"markers {a!r} and {b!r} can overlap")


MARKERS = Markers()


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, markers: Markers = MARKERS) -> DataFrame:
    """``docs`` with ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``rate`` per cent of the texts are cut, and of these ``spm_rate`` per cent put the suffix first.  A null or empty text
    and one that holds a marker stay plain; a null id draws as an empty one.  Rows are treated one by one: equal ids with
    equal texts get equal results, and other columns are kept, but for those of the five names, which are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("output", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]  # of the digest
    plain = (text == "") | (h[2] % 100 >= rate)
    for mark in (markers.prefix, markers.suffix, markers.middle):
        plain = plain | F.contains(text, F.lit(mark))
    cuts = [h[i] % (F.col("n") + 1) for i in range(2)]
    first, more = F.col("prefix_chars").cast("string"), (F.col("middle_chars") - F.col("prefix_chars")).cast("string")
    pattern = F.concat(F.lit(rf"(?s)\A({LINE}{{"), first, F.lit(rf"}}+)({LINE}{{"), more, F.lit(r"}+)(.*+)\z"))
    p, s, m = (x.replace("\\", "\\\\").replace("$", "\\$") for x in (markers.prefix, markers.suffix, markers.middle))
    cut, spm = F.col("form") != PLAIN, F.col("form") == SPM
    order = F.when(spm, f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    at_p, at_s, at_m = (F.locate(x, F.col("output")) for x in (markers.prefix, markers.suffix, markers.middle))
    return (docs
            .withColumns({"n": F.regexp_count(text, F.lit(LINE)).cast("long"), "output": digest})
            .withColumns({"form": F.when(plain, PLAIN).when(h[3] % 100 < spm_rate, SPM).otherwise(PSM),
                          "prefix_chars": F.least(*cuts), "middle_chars": F.greatest(*cuts)})  # the two cuts, in lines
            .withColumn("output", F.when(cut, F.regexp_replace(text, pattern, order)).otherwise(text))
            .withColumns({
                "prefix_chars": F.when(cut, F.when(spm, at_m).otherwise(at_s) - at_p - len(markers.prefix)).cast("long"),
                "middle_chars": F.when(cut, F.char_length("output") - at_m - len(markers.middle) + 1).cast("long")}))


def restored(output: Column, form: Column, markers: Markers = MARKERS) -> Column:
    """The text that ``transformed`` was given, from its output and form."""
    p, s, m = (re.escape(x) for x in (markers.prefix, markers.suffix, markers.middle))
    return (F.when(form == PSM, F.regexp_replace(output, F.lit(rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z"), F.lit("$1$3$2")))
            .when(form == SPM, F.regexp_replace(output, F.lit(rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z"), F.lit("$2$3$1")))
            .otherwise(output))


def digests(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, markers: Markers = MARKERS) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars`` and digests of each output and of the text rebuilt from it."""
    return transformed(docs.select("doc_id", "text"), seed, rate, spm_rate, markers).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form"), markers), 256).alias("restored_sha256"))
