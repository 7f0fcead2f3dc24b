"""Schemas of the stored tables: what is read is cut to these, and nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = {
    "observation": "id string, source string, series string, breakdown string, category string, period string, value double, unit string, yoy double, status string, rse double, rse_flag string, released_at date, release_url string, attachments array<struct<type:string,url:string>>, collected_at timestamp",
    "forecast": "id string, org string, org_name string, report_title string, published_at date, target_year int, target_period string, indicator string, value double, unit string, prev_value double, revision double, source_url string, landing_url string, source_page int, confidence string, collected_at timestamp",
    "rationale": "org string, published_at date, indicator string, text string, tags array<string>, source_url string, source_page int, warnings array<string>",
    "release": "id string, source string, month string, title string, posted_at date, url string, attachments array<struct<type:string,url:string>>",
    "report": "id string, org string, board string, series string, title string, authors array<string>, published date, date_precision string, pages int, landing_url string, file_url string, abstract string, toc array<string>, matched array<string>",
    "article": "release date, kind string, title string, url string, press string, pub timestamp, cites boolean, judged boolean, why string, hits array<string>, tone array<string>, stance string, focus string, kw array<string>",
    "hit": "id long, ts timestamp, day string, domain string, path string, visitor string, session string, ref string, ref_kind string, mode string, device string, country string",
    "visitor": "visitor string, first_day string, last_day string, hits long, day_hits long",
}


def columns(table: str) -> list[str]:
    return [c.strip().split()[0] for c in _split(TABLES[table])]


def _split(ddl: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[last:i])
            last = i + 1
    return [*out, ddl[last:]]


def project(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns alone, of its types; a column that df lacks is null."""
    want = {c.strip().split(" ", 1)[0]: c.strip().split(" ", 1)[1] for c in _split(TABLES[table])}
    return df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in want.items()))
