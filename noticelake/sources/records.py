"""Typed rows from the JSON records of an upstream service: notices, projects and their documents.

Records are irregular, so nothing here fails: a missing or odd value becomes the empty string or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T

#: Field -> (key of a notice record, most characters).
NOTICE = {
    "notice_type": ("notice_type", 255),
    "notice_status": ("notice_status", 64),
    "notice_language": ("notice_lang_name", 64),
    "deadline_time": ("submission_deadline_time", 32),
    "country": ("project_ctry_name", 255),
    "project_id": ("project_id", 64),
    "project_name": ("project_name", None),
    "bid_reference_no": ("bid_reference_no", 255),
    "bid_description": ("bid_description", None),
    "procurement_group": ("procurement_group", 32),
    "procurement_method_code": ("procurement_method_code", 32),
    "procurement_method_name": ("procurement_method_name", 255),
    "contact_name": ("contact_name", 255),
    "contact_organization": ("contact_organization", 512),
    "contact_email": ("contact_email", 320),
    "contact_phone_no": ("contact_phone_no", 128),
    "contact_address": ("contact_address", None),
    "contact_country": ("contact_ctry_name", 255),
    "contact_web_url": ("contact_web_url", 512),
}
#: The same for projects and documents; a document's key may have a second name.
PROJECT = {
    "name": ("project_name", None),
    "country": ("countryshortname", 255),
    "status": ("status", 64),
    "lending_instrument": ("lendinginstr", 255),
    "implementing_agency": ("impagency", None),
    "team_lead": ("teamleadname", None),
    "total_amount_display": ("totalamt", 64),
    "project_url": ("url", 500),
}
DOCUMENT = {
    "guid": (("guid", "id"), 64),
    "title": (("display_title", "docna"), None),
    "doc_type": (("docty",), 255),
    "language": (("lang",), 64),
    "pdf_url": (("pdfurl",), 1000),
    "text_url": (("txturl",), 1000),
    "page_url": (("url",), 1000),
}
#: What marks the review summary among a project's documents.
REVIEW_TYPE, REVIEW_TITLE, REVIEW_STAGE = "environmental and social review summary", "environmental and social review summary", "appraisal"
LONGEST = 1 << 30


def fields(record: Column) -> Column:
    """map<string,string> of a record's keys; nested values as JSON, empty for bad JSON."""
    return F.coalesce(F.from_json(record, "map<string,string>"), F.create_map().cast("map<string,string>"))


def text_of(value: Column, most: int | None = None) -> Column:
    """A value as clean text; a list is joined by spaces."""
    joined = F.array_join(F.from_json(value, "array<string>"), " ")
    return S.clean_str(F.when(value.startswith("["), F.coalesce(joined, value)).otherwise(value), most or LONGEST)


def record_date(value: Column) -> Column:
    """A date of a record: day-month-year forms, ISO dates and timestamps, and month first as a last try."""
    v = F.trim(value)
    return F.coalesce(S.parse_date(value), F.when(F.substring(v, 3, 1) == "/", F.try_to_date(v, "MM/dd/yyyy")))


def instant(value: Column) -> Column:
    """An ISO timestamp, in UTC where it names no zone, or else a date's midnight."""
    v = F.trim(value)
    return F.coalesce(v.try_cast("timestamp"), record_date(v).cast("timestamp"))


def canonical_hash(m: Column) -> Column:
    """SHA-256 over the keys and values in key order."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))), 256)


def map_notices(raw: DataFrame, record: str = "record", zones: dict[str, str] | None = None) -> DataFrame:
    """One row per usable record: the fields of NOTICE, dates, deadline instant, raw and clean text, content hash.

    Records without an id go.  ``zones`` has a time zone for each country that is known.
    """
    m = F.col("__m")
    # told of the parsed record itself: a filter on it would go down to the source and parse the record again for each use of its id
    usable = F.filter(F.array(fields(F.col(record))), lambda x: text_of(x["id"], 64) != "")
    found = raw.select(F.explode(usable).alias("__m")).withColumn("notice_id", text_of(m["id"], 64))
    values = {name: text_of(m[key], most) for name, (key, most) in NOTICE.items()}
    zone = F.create_map(*[F.lit(x) for p in zones.items() for x in p])[F.col("country")] if zones else F.lit(None).cast("string")
    dated = found.withColumns(values).withColumns(
        {"notice_date": record_date(m["noticedate"]), "submission_date": instant(m["submission_date"]), "deadline_date": instant(m["submission_deadline_date"])}
    )
    body = F.coalesce(m["notice_text"], F.lit(""))
    at = S.deadline_instant(F.col("deadline_date").cast("date"), S.clock_minutes(F.col("deadline_time")), zone)
    full = dated.withColumns({"deadline_at": at, "notice_text_raw": body, "notice_text_sanitized": T.sanitize(body), "content_hash": canonical_hash(m)})
    return full.drop("__m")


def map_projects(raw: DataFrame, record: str = "record") -> DataFrame:
    """One row per record: project_id, the fields of PROJECT, sectors, themes, amounts and dates."""
    m = F.col("__m")
    values = {name: text_of(m[key], most) for name, (key, most) in PROJECT.items()}
    themes = S.names_of(m["theme"])
    found = raw.select(fields(F.col(record)).alias("__m")).withColumn("project_id", text_of(m["id"], 64)).withColumns(values)
    return found.withColumns(
        {
            "sectors": S.names_of(m["sector"]),
            "themes": F.when(F.size(themes) > 0, themes).otherwise(S.names_of(m["theme_list"])),
            "total_amount_usd": S.parse_money(m["totalamt"]),
            "commitment_amount_usd": S.parse_money(m["totalcommamt"]),
            "board_approval_date": record_date(m["boardapprovaldate"]),
            "closing_date": record_date(m["closingdate"]),
        }
    ).drop("__m")


def map_documents(raw: DataFrame, record: str = "record", project: str = "project_id") -> DataFrame:
    """One row per record with an id: project_id, the fields of DOCUMENT, doc_date."""
    m = F.col("__m")
    first = lambda keys: F.coalesce(*[F.nullif(m[k], F.lit("")) for k in keys])
    found = raw.select(F.col(project).alias("project_id"), fields(F.col(record)).alias("__m"))
    values = {name: text_of(first(keys), most) for name, (keys, most) in DOCUMENT.items()}
    return found.withColumns(values).withColumn("doc_date", record_date(m["docdt"])).where("guid <> ''").drop("__m")


def pick_review(documents: DataFrame) -> DataFrame:
    """The review summary of each project: project_id, guid, title, doc_date, report_no.

    By document type or by title; those of the appraisal first, then the newest, then by guid.  Projects
    without one have no row.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    some = documents.where(F.contains(low("doc_type"), F.lit(REVIEW_TYPE)) | F.contains(low("title"), F.lit(REVIEW_TITLE)))
    rank = F.struct(F.contains(low("title"), F.lit(REVIEW_STAGE)).alias("stage"), F.coalesce("doc_date", F.lit("0001-01-01").cast("date")).alias("on"), F.col("guid"))
    best = some.groupBy("project_id").agg(F.max_by(F.struct("guid", "title", "doc_date"), rank).alias("x"))
    return best.select("project_id", "x.*", S.report_number(F.col("x.title")).alias("report_no"))
