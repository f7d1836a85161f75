"""People and mailboxes of notice bodies, with what an address is for, and the tiers of a notice's contacts.

A name introduced as a person is an anchor.  It owns the text up to the next anchor, WINDOW characters behind its end at
most; phone numbers and addresses fall into these intervals.  An address in a person's interval is theirs if it
names them or is a unit's mailbox; otherwise it stands alone, without a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .scalars import let
from .spans import before, spans
from .text import unescaped

WINDOW, PURPOSE_BACK, TOR_BACK, CONTEXT = 420, 200, 220, 160
#: How addresses, people and numbers are written, and labels of an address block.
ADDRESS = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]{2,}"
LABELS = r"Attn|Attention|Address|Street|City|Country|Postal|Zip|Tel(?:ephone)?|Phone(?:\s+number)?|Mobile|Cell|Fax|E-?mail|Web\s*site|URL"
NAME_PART = r"(?:[A-Z][\w'’\-]+|[A-Z]\.(?:[A-Z]\.)*)"
LEAD = r"\b(?:Attn|Attention|To|Contact\s+person|Contact)\s*[:.]\s*(?:(?:Mr|Mrs|Ms|Miss|Dr|Eng|Ing|Prof|Sr|Sra)\.?\s+)?"
ROLE = r"(?:\s*[,\-–—]\s*([A-Za-z][A-Za-z\s/&'’-]{2,58}?))?"
PERSON = rf"(?U){LEAD}({NAME_PART}(?:\s+{NAME_PART}){{0,3}}){ROLE}(?=\s*(?:{LABELS})\s*[:.]|[.;,]|\s+\d|\s*$)"
NUMBER = rf"(?i)(?:{LABELS})\s*[:.]?\s*([+(]?\d[\d\s()\-–./]{{6,24}}\d)"
#: What an address is for, by the words in front of it; the first that fits counts.
TOR = r"(?i)terms?\s+of\s+reference|\bto\s*rs?\b|\btors?\b"
PURPOSES = (
    (
        "submission",
        r"(?is)must\s+be\s+(?:delivered|submitted|sent|received)|shall\s+be\s+(?:delivered|submitted|sent)|expressions?\s+of\s+interest.{0,80}?(?:to|at)\b|"
        r"(?:bids?|quotations?|proposals?|applications?)\b.{0,60}?(?:delivered|submitted|sent)|deliver(?:ed)?\s+(?:electronically\s+)?to|(?:receipt\s+and\s+)?submission\s+of",
    ),
    ("tor", TOR),
    ("enquiry", r"(?i)further\s+information|more\s+information|additional\s+information|clarification|inquir|enquir|questions?\s+(?:may|should|can)|obtained?\s+(?:at|from|through)"),
)
#: Fixed value: parts of an address that name an office, not a person.
OFFICES = ("procurement", "tender", "bids", "bid", "info", "office", "piu", "pmu", "pcu", "admin", "secretariat", "contact", "mail", "eoi")
#: Fixed value: tiers and their priority.
TIERS = {"notice": 1, "body": 2, "bank": 3}


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def name_tokens(name: Column) -> Column:
    """Parts of a name that tell people apart, folded over ways of writing; initials are none."""
    t = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[’'`]", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[^a-z\\s]", " "), "kh", "x"), "ph", "f")
    return F.array_distinct(F.filter(F.split(t, r"\s+"), lambda x: F.length(x) > 2))


def same_person(a: Column, b: Column) -> Column:
    return F.arrays_overlap(name_tokens(a), name_tokens(b))


def clean_address(raw: Column) -> Column:
    """Without the stop of its sentence; empty if no domain is left."""
    a = F.regexp_replace(raw, "[.-]+$", "")
    return F.when(a.rlike(r"^.+@[^@]*\.[^@]*$"), a).otherwise("")


def belongs(email: Column, name: Column) -> Column:
    """Whether an address in a person's interval is theirs: a mailbox of an office, or one that names them."""
    local = F.substring_index(email, "@", 1)
    office = F.lower(local).rlike("|".join(OFFICES))
    return office | same_person(F.regexp_replace(local, r"[._\-+\d]+", " "), name)


def purpose(context: Column) -> Column:
    found = F.lit("")
    for name, pattern in reversed(PURPOSES):
        found = F.when(context.rlike(pattern), name).otherwise(found)
    return found


def _clean_role(raw: Column) -> Column:
    role = F.regexp_replace(squeezed(raw), r"^[\s\-–—,.]+|[\s\-–—,.]+$", "")
    return F.when((F.length(role) > 60) | (F.size(F.split(role, " ")) > 7), "").otherwise(role)


def body_contacts(docs: DataFrame) -> DataFrame:
    """Contacts of bodies (doc_id, text): doc_id, place, name, role, email, others, phone, purpose, context.

    People with an address or a number first, in order, then the addresses that are no one's.  An address counts
    once a body, in any case, where it stands first.  Null and empty texts have none.
    """
    t = F.col("text")
    text = F.when(F.contains(t, F.lit("&")), unescaped(t)).otherwise(F.coalesce(t, F.lit("")))
    marked = spread(docs.select("doc_id", "text"), "doc_id").select("doc_id", text.alias("text")).select("doc_id", "text", spans(F.col("text"), PERSON).alias("p"), spans(F.col("text"), NUMBER).alias("n"), spans(F.col("text"), ADDRESS).alias("e"))
    person = lambda x: F.struct(
        squeezed(F.regexp_extract(x["text"], PERSON, 1)).alias("name"), _clean_role(F.regexp_extract(x["text"], PERSON, 2)).alias("role"), x["start"].alias("start"), x["stop"].alias("stop")
    )
    people = F.filter(F.transform("p", person), lambda a: F.size(name_tokens(a["name"])) > 0)
    marked = marked.withColumn("p", people)
    nearest = F.transform("p", lambda a, i: F.least(F.coalesce(F.get("p", i + 1)["start"], F.length("text")), a["stop"] + WINDOW))
    owned = F.transform(
        F.zip_with("p", nearest, lambda a, stop: F.struct(a.alias("a"), stop.alias("stop"))),
        lambda x: F.struct(
            x["a"]["name"].alias("name"), x["a"]["role"].alias("role"), x["a"]["start"].alias("start"), x["stop"].alias("stop"),
            F.coalesce(F.get(F.filter("n", lambda n: (n["start"] >= x["a"]["start"]) & (n["start"] < x["stop"])), F.lit(0))["text"], F.lit("")).alias("raw"),
        ),
    )
    marked = marked.withColumn("p", owned)
    # the first place of each address
    named = F.filter(F.transform("e", lambda e: F.struct(clean_address(e["text"]).alias("email"), e["start"].alias("start"))), lambda e: e["email"] != "")
    once = F.filter(named, lambda e, i: F.array_position(F.transform(named, lambda o: F.lower(o["email"])), F.lower(e["email"])) == i + 1)
    marked = marked.withColumn("e", once)
    inside = lambda a, e: (a["start"] <= e["start"]) & (e["start"] < a["stop"])
    owner = lambda e: let(
        F.coalesce(F.get(F.filter(F.transform("p", lambda a, i: F.when(inside(a, e), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(-1)),
        lambda i: F.when((i >= 0) & belongs(e["email"], F.get("p", i)["name"]), i).otherwise(-1),
    )
    marked = marked.withColumn("e", F.transform("e", lambda e: F.struct(e["email"].alias("email"), e["start"].alias("start"), owner(e).alias("owner"))))
    context = lambda at: squeezed(before(F.col("text"), at, PURPOSE_BACK))
    theirs = lambda i: F.transform(F.filter("e", lambda e: e["owner"] == i), lambda e: e["email"])

    def contact(name, role, emails, phone, why, said):
        return F.struct(
            name.alias("name"), role.alias("role"), F.coalesce(F.get(emails, F.lit(0)), F.lit("")).alias("email"), F.slice(emails, 2, 100_000).alias("others"), phone.alias("phone"), why.alias("purpose"), said.alias("context")
        )

    number = lambda raw: squeezed(F.regexp_extract(raw, NUMBER, 1))
    nothing = F.lit("")
    of_people = F.filter(
        F.transform("p", lambda a, i: contact(a["name"], a["role"], theirs(i), number(a["raw"]), purpose(context(a["start"])), nothing)),
        lambda c: (c["email"] != "") | (c["phone"] != ""),
    )
    alone = F.transform(
        F.filter("e", lambda e: e["owner"] < 0),
        lambda e: let(context(e["start"]), lambda c: contact(nothing, nothing, F.array(e["email"]), nothing, purpose(c), F.substr(c, F.greatest(F.length(c) - CONTEXT, F.lit(0)) + 1))),
    )
    return marked.select("doc_id", F.posexplode(F.concat(of_people, alone)).alias("place", "c")).select("doc_id", "place", "c.*")


def beside_primary(found: DataFrame, primary: DataFrame) -> DataFrame:
    """``found`` (of ``body_contacts``) without what ``primary`` (doc_id, name, email, phone) says already, and same_as_primary.

    An address or number that is the primary's goes; a contact of which nothing is left goes with it.
    """
    p = primary.select("doc_id", F.struct("name", F.lower(F.coalesce("email", F.lit(""))).alias("email"), F.regexp_replace(F.coalesce("phone", F.lit("")), r"\D", "").alias("phone")).alias("p"))
    joined = found.join(p, "doc_id", "left")
    fresh = F.filter(F.concat(F.array("email"), "others"), lambda a: (a != "") & (F.lower(a) != F.coalesce(F.col("p.email"), F.lit(""))))
    repeated = F.regexp_replace("phone", r"\D", "") == F.coalesce(F.col("p.phone"), F.lit(""))
    kept = joined.withColumns({"f": fresh, "phone": F.when(repeated, "").otherwise(F.col("phone"))}).where((F.size("f") > 0) | (F.col("phone") != ""))
    same = (F.col("name") != "") & F.coalesce(same_person(F.col("name"), F.col("p.name")), F.lit(False))
    return kept.select("doc_id", "place", "name", "role", F.coalesce(F.get("f", F.lit(0)), F.lit("")).alias("email"), F.slice("f", 2, 100_000).alias("others"), "phone", "purpose", "context", same.alias("same_as_primary"))


def tiers(primary: DataFrame, found: DataFrame, people: DataFrame) -> DataFrame:
    """All contacts of notices by strength: doc_id, priority, tier, place, name, role, email, phone, purpose, same_as_primary.

    ``primary``: doc_id, name, email, phone, as published (blank rows go); ``found``: ``body_contacts``; ``people``: doc_id, place, name, title, email, phone
    of the project's team, where what was published of a person wins over what was found: see ``team``.
    """
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    first = primary.select("doc_id", clean("name").alias("name"), clean("email").alias("email"), clean("phone").alias("phone")).where("concat(name, email, phone) <> ''")
    row = lambda tier, df, role, why, same: df.select(
        "doc_id", F.lit(TIERS[tier]).alias("priority"), F.lit(tier).alias("tier"), "place", "name", role.alias("role"), "email", "phone", why.alias("purpose"), same.alias("same_as_primary")
    )
    no = F.lit(False)
    own = row("notice", first.withColumn("place", F.lit(0)), F.lit(""), F.lit(""), no)
    body = row("body", beside_primary(found, first), F.col("role"), F.col("purpose"), F.col("same_as_primary"))
    return own.union(body).union(row("bank", people, F.col("title"), F.lit(""), no))


def team(leads: DataFrame, published: DataFrame, looked_up: DataFrame) -> DataFrame:
    """The project's people: doc_id, place, name, title, email, phone.

    ``leads``: doc_id, leads (names between commas), which says who and in what order; ``published``: doc_id, name, title, email, phone of
    the project's own papers; ``looked_up``: name, title, email.  Published words win; people that only the papers
    name come last, by name.  A name is the same person's however it is written.
    """
    key = lambda c: F.array_join(F.array_sort(name_tokens(c)), " ")
    each = leads.select("doc_id", F.posexplode(F.split(F.coalesce("leads", F.lit("")), ",")).alias("place", "name"))
    each = each.select("doc_id", "place", squeezed(F.col("name")).alias("name")).where("name <> ''").withColumn("key", key(F.col("name")))
    papers = published.select("doc_id", key(F.col("name")).alias("key"), F.struct("name", "title", "email", "phone").alias("p"))
    papers = papers.groupBy("doc_id", "key").agg(F.min("p").alias("p"))
    found = looked_up.select(key(F.col("name")).alias("key"), F.struct("title", "email").alias("f")).groupBy("key").agg(F.min("f").alias("f"))
    both = each.join(papers, ["doc_id", "key"], "full").join(found, "key", "left")
    text = lambda *c: F.coalesce(*(F.nullif(F.trim(F.col(x)), F.lit("")) for x in c), F.lit(""))
    order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("place"), "p.name")
    named = both.withColumn("at", (F.row_number().over(order) - 1).cast("int"))
    return named.select("doc_id", F.col("at").alias("place"), text("name", "p.name").alias("name"), text("p.title", "f.title").alias("title"), text("p.email", "f.email").alias("email"), text("p.phone").alias("phone"))


def tor_address(text: Column) -> Column:
    """The first address that words on the terms of reference introduce; empty if none is."""
    t = F.coalesce(text, F.lit(""))
    found = F.filter(spans(t, ADDRESS), lambda e: before(t, e["start"], TOR_BACK).rlike(TOR) & (clean_address(e["text"]) != ""))
    return F.coalesce(clean_address(F.get(found, F.lit(0))["text"]), F.lit(""))


def mentions_tor(text: Column) -> Column:
    return F.coalesce(text.rlike(TOR), F.lit(False))
