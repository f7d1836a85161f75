"""Which documents are registered, read and asked next, and whom they name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contacts as C
from ..functions import scalars as S
from ..functions import text as T

#: Fixed value: the slug of a role that has no row.
OTHER = "other"


def refusal(status: Column, text_layer: Column, chars: Column, text: Column, least: int = 200) -> Column:
    """Why a harvested document is not read: ``not_fetched``, ``no_text_layer``, ``too_short``, ``empty_text``, or the empty string.

    An unknown text layer is no reason; a missing count is zero.
    """
    return (
        F.when(F.coalesce(status, F.lit("")) != "fetched", "not_fetched").when(F.coalesce(~text_layer, F.lit(False)), "no_text_layer")
        .when(F.coalesce(chars, F.lit(0)) < least, "too_short").when(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) == "", "empty_text").otherwise("")
    )


def discover(sources: list[DataFrame], known: DataFrame, limit: int) -> DataFrame:
    """The next ``limit`` links to register: key, url, title, source (its number), place.

    ``sources``: url, title, place (a total order), in falling order of their claim; ``known``: key.  A link counts once, where it
    stands first.  The limit is one of new links, so that each run goes on where the last one stopped.
    """
    rows = [df.select(S.url_key(F.col("url")).alias("key"), "url", "title", F.lit(i).alias("source"), "place") for i, df in enumerate(sources)]
    every = reduce(DataFrame.unionByName, rows).where("url IS NOT NULL AND url <> '' AND key <> ''")
    fresh = every.join(known.select("key").distinct(), "key", "left_anti")
    first = fresh.groupBy("key").agg(F.min(F.struct("source", "place", "url", "title")).alias("x"))
    return first.orderBy("x.source", "x.place", "key").limit(limit).select("key", "x.url", "x.title", "x.source", "x.place")


def roles_of(positions: DataFrame, roles: DataFrame) -> DataFrame:
    """``positions`` (slug and others) with role_id: null for no slug, OTHER, or a role that is gone.  ``roles``: role_id, name."""
    named = roles.select("role_id", S.slug(F.col("name")).alias("slug")).groupBy("slug").agg(F.min("role_id").alias("role_id"))
    asked = positions.withColumn("slug", F.when((F.col("slug") != OTHER) & (F.col("slug") != ""), F.col("slug")))
    return asked.join(named, "slug", "left")


def lead_queue(profiles: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """Team leads who were not looked up yet: name, project, projects (how many name them); the first ``limit`` by their first project.

    ``profiles``: project, leads (names between commas); ``known``: name.  A name is one however it is written, and is shown as
    its first project writes it.
    """
    each = profiles.select("project", F.explode(F.split(F.coalesce("leads", F.lit("")), ",")).alias("name")).select("project", F.trim(F.regexp_replace("name", r"\s+", " ")).alias("name"))
    each = each.withColumn("key", S.fold_name(F.col("name"))).where("key <> ''")
    fresh = each.join(known.select(S.fold_name(F.col("name")).alias("key")).distinct(), "key", "left_anti")
    first = fresh.groupBy("key").agg(F.min(F.struct("project", "name")).alias("x"), F.countDistinct("project").alias("projects"))
    return first.orderBy("x.project", "x.name").limit(limit).select("x.name", "x.project", "projects")


def published_contacts(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """People that a project's own summary names: doc_id (the project), name, title, label, email, phone.

    ``projects``: project, url of the summary; ``documents``: key, status, text of harvested ones.  A summary is found by the hash
    of its address, whatever way it is written, and counts if it was fetched.
    """
    asked = projects.where("url IS NOT NULL AND url <> ''").select(F.col("project").alias("doc_id"), S.url_key(F.col("url")).alias("key"))
    found = asked.join(documents.where("status = 'fetched'").select("key", "text"), "key")
    return T.contact_points(found.select("doc_id", "text"))


def contact_sheet(notices: DataFrame, projects: DataFrame, documents: DataFrame, looked_up: DataFrame) -> DataFrame:
    """``contacts.tiers`` of notices (doc_id, project, text, name, email, phone) with the people of their projects.

    ``projects``: project, leads, url; ``documents``: as in ``published_contacts``; ``looked_up``: name, title, email.
    """
    own = notices.select("doc_id", "project").where("project IS NOT NULL")
    papers = published_contacts(projects, documents).withColumnRenamed("doc_id", "project")
    leads = own.join(projects.select("project", "leads"), "project").select("doc_id", "leads")
    people = C.team(leads, own.join(papers, "project").select("doc_id", "name", "title", "email", "phone"), looked_up)
    return C.tiers(notices.select("doc_id", "name", "email", "phone"), C.body_contacts(notices.select("doc_id", "text")), people)
