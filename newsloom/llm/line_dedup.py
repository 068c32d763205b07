"""Line dedup over overlapping windows of three lines, in DataFrame functions alone.

Lines are what ``\\n`` separates. Each window of three consecutive lines is
hashed; a window that occurs more than once keeps its first occurrence, by
(doc_id, line), and every line under a later occurrence goes. Windows are
judged on the input, so occurrences may overlap; what they cover is merged.

Defined results. A null text has no lines and stays null. Fewer than three
lines make no window, and windows of white space alone are passed over, so
such texts stay as they are. Rows alike in doc_id and text are one document:
each of them keeps or loses the same lines. A null doc_id counts as the
smallest. A text that loses every line becomes empty. An empty table gives no
row. Texts of any length are read whole, as arrays of their lines. Further
columns of the table pass through, whatever their names.

At scale: windows are aggregated to their first occurrence before the shuffle,
so a passage that a third of all documents share is one row for each task; the
join back to the windows is a plain equi-join whose skewed side Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.llm.names import free, without

LINES = 3


def _windows(lines: Column) -> Column:
    """The 128-bit hash of each window, null for one of white space alone."""
    n = F.greatest(F.size(lines) - (LINES - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice(lines, F.lit(k + 1), n).alias(f"l{k}") for k in range(LINES)])
    joined = F.transform(zipped, lambda x: F.concat_ws("\n", *[x[f"l{k}"] for k in range(LINES)]))
    return F.transform(joined, lambda w: F.when(F.trim(F.translate(w, "\n\r\t", "   ")) != "", F.unhex(F.md5(w.cast("binary")))))


def dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_name: str = "n_lines", removed_name: str = "n_removed") -> DataFrame:
    """``documents`` with later occurrences cut from the text, and n_lines and n_removed (or other names) behind its columns;
    columns that have these names give way to them."""
    kept_columns = without(documents.columns, [lines_name, removed_name])
    documents = documents.select(*[F.col(f"`{c}`") for c in kept_columns])
    own_kid, own_lines = free("_kid", [*kept_columns, "kid", "id"]), free("_lines", kept_columns)
    rows = documents.withColumn(own_kid, F.xxhash64(F.col(id_col), F.col(text_col))).withColumn(own_lines, F.split(text_col, "\n", -1))
    found = rows.select(F.col(id_col).alias("id"), F.col(own_kid).alias("kid"), F.posexplode(_windows(F.col(own_lines))).alias("pos", "h")).where("h is not null")
    first = found.groupBy("h").agg(F.min(F.struct("id", "kid", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = found.join(first, "h").where(~F.struct("id", "kid", "pos").eqNullSafe(F.col("first"))).select("id", "kid", "pos").distinct()

    order = Window.partitionBy("kid", "id").orderBy("pos")
    ended = F.coalesce(F.lag("pos").over(order) + LINES, F.lit(0))
    cut = (
        later.withColumn("ended", ended)
        .groupBy("kid", "id")
        .agg(
            F.sum(F.col("pos") + LINES - F.greatest("ended", "pos")).cast("long").alias("n_removed"),
            F.max(F.col("pos") + LINES).alias("past"),
            F.array_sort(F.collect_list(F.when(F.col("pos") > F.col("ended"), F.struct(F.col("ended").alias("at"), (F.col("pos") - F.col("ended")).alias("n"))))).alias("kept"),
        )
    )
    lines = rows[own_lines]
    tail = F.slice(lines, cut["past"] + 1, F.greatest(F.size(lines) - cut["past"], F.lit(0)))
    left = F.concat(F.flatten(F.transform(cut["kept"], lambda g: F.slice(lines, g["at"] + 1, g["n"]))), tail)
    text = F.when(cut["past"].isNull(), rows[text_col]).otherwise(F.array_join(left, "\n"))
    joined = rows.join(cut, (rows[own_kid] == cut["kid"]) & rows[id_col].eqNullSafe(cut["id"]), "left")
    return joined.select(
        *[text.alias(c) if c == text_col else rows[f"`{c}`"] for c in documents.columns],
        F.greatest(F.size(lines), F.lit(0)).cast("long").alias(lines_name),
        F.coalesce(cut["n_removed"], F.lit(0)).cast("long").alias(removed_name),
    )


def digest(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and the text that is left."""
    return dedup(documents.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, p - 1 AS pos, lines[p] || chr(10) || lines[p + 1] || chr(10) || lines[p + 2] AS w
  FROM d, unnest(range(1, len(lines) - 1)) AS t(p)
), later AS (
  SELECT doc_id, pos FROM w WHERE trim(w, ' ' || chr(9) || chr(10) || chr(13)) <> ''
  QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, unnest([0, 1, 2]) AS t(k)
), lines AS (
  SELECT d.doc_id, p - 1 AS pos, lines[p] AS line FROM d, unnest(range(1, len(lines) + 1)) AS t(p)
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
), counted AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.lines), 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN counted c ON d.doc_id = c.doc_id
"""
