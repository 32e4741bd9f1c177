"""Sinks: exports of issues as CSV, JSON and Markdown, badges, messages, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import labels
from siteloom.operators.rules import titles

c = F.col
CSV_COLUMNS = ["code", "severity", "category", "title", "why", "fix", "impact", "effort"]


def csv_field(x: Column) -> Column:
    """A field that no spreadsheet reads as a formula; quoted where it has to be."""
    s = x.cast("string")
    formula = s.rlike(r"^[=+\-@\t\r]")
    risky = s.rlike("[|;,\"\n\r']")
    guarded = F.when(formula, F.concat(F.lit("'"), s)).otherwise(s)
    quoted = F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(s.isNull(), "").when(formula | risky, quoted).otherwise(s)


def described(issues: DataFrame) -> DataFrame:
    """Adds title, why and fix where they are missing."""
    for name, value in {"title": titles(c("code")), "why": F.lit(None).cast("string"), "fix": F.lit(None).cast("string")}.items():
        if name not in issues.columns:
            issues = issues.withColumn(name, value)
    return issues


def csv_lines(issues: DataFrame) -> DataFrame:
    """(scan_id, n, line) for each issue; write_csv() adds the header."""
    return described(issues).select("scan_id", "n", F.concat_ws(",", *(csv_field(c(k)) for k in CSV_COLUMNS)).alias("line"))


def write_csv(issues: DataFrame, path: str) -> None:
    """One folder for each scan with lines that end in CR LF, the header first."""
    lines = csv_lines(issues)
    head = lines.select("scan_id").distinct().select("scan_id", F.lit(None).cast(lines.schema["n"].dataType).alias("n"), F.lit(",".join(CSV_COLUMNS)).alias("line"))
    ordered = lines.unionByName(head).repartition("scan_id").sortWithinPartitions("scan_id", "n")
    ordered.select("scan_id", c("line").alias("value")).write.partitionBy("scan_id").option("lineSep", "\r\n").mode("overwrite").text(path)


def json_lines(issues: DataFrame) -> DataFrame:
    """(scan_id, n, json): each issue as a JSON object."""
    return described(issues).select("scan_id", "n", F.to_json(F.struct(*CSV_COLUMNS, "url", "evidence"), {"pretty": "true"}).alias("json"))


def markdown(issues: DataFrame) -> DataFrame:
    """(scan_id, category, text): the issues of a category as a section, in order."""
    d = described(issues)
    one = F.concat(F.lit("### ["), c("severity"), F.lit("] "), c("title"), *(F.coalesce(F.concat(F.lit(mark), x), F.lit("")) for mark, x in (("\n> ", c("why")), ("\n\n**Fix:** ", c("fix")), ("\n\n**Page:** ", F.nullif("url", F.lit(""))))), F.lit("\n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("t")))), lambda x: x["t"])
    return d.groupBy("scan_id", "category").agg(F.concat(F.lit("## "), F.first("category"), F.lit("\n\n"), F.array_join(listed, "\n")).alias("text"))


def badge(score: Column) -> Column:
    """A small SVG with the score and its grade."""
    return F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="120" height="20"><title>Score: '), score.cast("string"), F.lit("/100 ("), labels.grade(score), F.lit(')</title><rect width="75" height="20" fill="#555"/><rect x="75" width="45" height="20" fill="'),
        labels.colour(score), F.lit('"/><text x="97" y="14" fill="#fff" text-anchor="middle">'), score.cast("string"), F.lit("</text></svg>"),
    )


def share_token(token: Column) -> Column:
    """The token a scan has, or 16 random bytes in hex."""
    return F.coalesce(token, F.lower(F.concat(*(F.lpad(F.hex(F.floor(F.rand() * 65536).cast("long")), 4, "0") for _ in range(8)))))


def mail_draft(summary: DataFrame, top: DataFrame) -> DataFrame:
    """(scan_id, subject, body): scores and the worst issues as a message. top: (scan_id, rank,
    code, severity)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", c("rank").cast("string"), F.concat(F.lit("["), c("severity"), F.lit("]")), titles(c("code"))).alias("t")))), lambda x: x["t"])
    worst = top.groupBy("scan_id").agg(F.array_join(listed, "\n").alias("list"))
    from siteloom.operators.scoring import WEIGHTS

    scores = F.concat_ws("\n", *(F.concat(F.lit(f"{k.lower()}: "), c(k.lower()).cast("string"), F.lit("/100")) for k in WEIGHTS))
    s = summary.join(worst, "scan_id", "left")
    return s.select("scan_id", F.concat(F.lit("Audit of "), c("scan_id"), F.lit(": "), labels.mail_grade(c("overall"))).alias("subject"), F.concat_ws("\n\n", F.concat(F.lit("Overall: "), c("overall").cast("string"), F.lit("/100, pages: "), c("pages").cast("string")), scores, c("list")).alias("body"))


def alert_payload(scan: Column, delta: Column, reasons: Column) -> Column:
    """What a webhook gets: JSON with the reasons."""
    return F.to_json(F.struct(scan.alias("scan"), delta.alias("score_delta"), reasons.alias("reasons"), F.concat_ws("; ", reasons).alias("text")))


def escape_html(x: Column) -> Column:
    out = F.replace(x, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def append(df: DataFrame, path: str) -> None:
    """Batch insert into a Parquet table."""
    df.write.mode("append").parquet(path)


def newest(versions: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Keyed updates as appended versions: the last version of each key."""
    rest = [k for k in versions.columns if k not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("x")).select(*keys, "x.*")
