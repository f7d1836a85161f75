"""Awards read from notice bodies: bidders of three lists, prices, date, duration.

A body is a run of lines, as every tag ends one.  Each line has a kind by itself (heading of a section, start of a
bidder, label, country, address, text); windows over a notice's lines then tell in which section it stands, below
which bidder and behind which label.  That holds for both templates and for sections in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .text import decoded

#: Headings of sections, labels and how values are written.
SECTIONS = (("evaluated", ("evaluated bidder",)), ("awardee", ("awarded bidder", "awarded firm")), ("rejected", ("rejected bidder",)), ("none", ("beneficial ownership details",)))
PRICES = (("opening", ("bid price at opening",)), ("evaluated", ("evaluated bid price",)), ("contract", ("signed contract price", "contract price")))
OTHER_LABELS = ("evaluation scores", "reason for rejection", "registry id")
BARE_LABELS = ("price", "currency", "amount", "scores", "technical", "financial")
DATE_LABELS, DURATION_LABEL = ("date notification of award issued", "contract signature date"), "duration of contract"
ANONYMOUS = ("individual consultant", "individual")
NO_ADDRESS = ("-", "--", "n/a", "na", ".")
REFERENCE, MONEY = r"\((\d{3,})\)\s*$", r"([A-Z]{3})?\s*(\d[\d,.]*)"
#: Lines behind a label in which its value stands: of a price, an amount, a date, a duration.
NEAR_PRICE, NEAR_AMOUNT, NEAR_DATE, NEAR_DURATION = 2, 4, 3, 2


def _lines(bodies: DataFrame) -> DataFrame:
    """notice_id, n (from 0), line, low: what stands between tags, references decoded, blank lines out.

    Bodies are dealt by notice before they are cut, so that their lines, which are many times as many rows, need no shuffle.
    """
    flat = bodies.select("notice_id", F.regexp_replace(F.coalesce("html", F.lit("")), r"<[^>]+>", "\n").alias("__t"))
    plain = flat.select("notice_id", F.when(F.contains("__t", F.lit("&")), decoded(F.col("__t"))).otherwise(F.col("__t")).alias("__t"))
    t = F.regexp_replace("__t", r"(?U)[\s&&[^\n]]+", " ")
    kept = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return spread(plain, "notice_id").select("notice_id", F.posexplode(kept).alias("n", "line")).withColumn("low", F.lower("line"))


def _any(column: Column, starts: tuple[str, ...]) -> Column:
    found = column.startswith(starts[0])
    for x in starts[1:]:
        found = found | column.startswith(x)
    return found


def _read(bodies: DataFrame) -> DataFrame:
    """Lines with what they are and where they stand; every window has one order, so that a notice is sorted once."""
    low, line = F.col("low"), F.col("line")
    section = F.lit(None).cast("string")
    for name, words in reversed(SECTIONS):
        for w in words:
            section = F.when(F.contains(low, F.lit(w)), name).otherwise(section)
    bare = F.trim(F.rtrim(low, F.lit(":")))
    label = F.when(bare.isin(*BARE_LABELS), bare)
    for x in OTHER_LABELS:
        label = F.when(low.startswith(x), x).otherwise(label)
    for name, words in reversed(PRICES):
        label = F.when(_any(low, words), name).otherwise(label)
    label = F.when(_any(low, DATE_LABELS), "date").when(low.startswith(DURATION_LABEL), "duration").otherwise(label)
    lines = _lines(bodies).withColumn("section", section).withColumn("label", F.when(F.col("section").isNull(), label))
    after = lambda word: F.when(low.startswith(word), F.regexp_extract("line", rf"(?i)^{word}\s*:\s*(.*)$", 1)).otherwise("")
    kind = (
        F.when(F.col("section").isNotNull(), "heading").when(after("name") != "", "start").when(line.endswith(")") & line.rlike(REFERENCE), "start").when(F.col("label").isNotNull(), "label")
        .when(after("country") != "", "country").when(low.startswith("address") & low.rlike(r"^address\s*:"), "address").otherwise("text")
    )
    lines = lines.withColumn("kind", kind).withColumn("label", F.when(F.col("kind") == "label", F.col("label")))
    # a value may stand on the line of its name or label
    words = "|".join(w for _, ws in PRICES for w in ws)
    value = (
        F.when((F.col("kind") == "start") & (after("name") != ""), after("name")).when(F.col("kind") == "address", after("address"))
        .when((F.col("kind") == "label") & F.col("label").isin(*(n for n, _ in PRICES)), F.regexp_replace("line", rf"(?i)^({words})", "")).otherwise(line)
    )
    lines = lines.withColumns({"value": value, "country": F.when(F.col("kind") == "country", after("country"))})
    order = Window.partitionBy("notice_id").orderBy("n")
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda what, over: F.last(what, ignorenulls=True).over(over)
    where = lambda condition: F.when(condition, F.col("n"))
    lines = lines.withColumns(
        {
            "role": F.coalesce(last(F.col("section"), so_far), F.lit("")),
            "heading_at": F.coalesce(last(where(F.col("section").isNotNull()), so_far), F.lit(-1)),
            "last_label": last(F.col("label"), so_far),
            "label_at": last(where(F.col("label").isNotNull()), so_far),
            "seen_at": F.coalesce(last(where(F.col("kind").isin("start", "text")), earlier), F.lit(-2)),
            "before": F.lag("label").over(order),
        }
    )
    bidding = F.col("role").isin("awardee", "evaluated", "rejected")
    reason = (F.col("role") == "rejected") & F.coalesce(F.col("before") == "reason for rejection", F.lit(False)) & F.col("kind").isin("start", "text")
    # a section whose first bidder is written without name label and reference starts with its first plain line
    start = bidding & ~F.col("reason") & ((F.col("kind") == "start") | ((F.col("kind") == "text") & (F.col("seen_at") < F.col("heading_at"))))
    lines = lines.withColumn("reason", reason).withColumn("start", start)
    return lines.withColumns(
        {
            "bidder": F.count_if("start").over(so_far),
            "start_at": F.coalesce(last(where(F.col("start")), so_far), F.lit(-2)),
            # what closes a bidder's address: a label, a heading or the country behind its start
            "closed": last(F.when(F.col("start"), F.lit(False)).when(F.col("kind").isin("label", "country", "heading"), F.lit(True)), so_far),
            "away": F.col("n") - F.col("label_at"),
        }
    )


def _of_price(name: str) -> Column:
    """The line is the label of a price, or one of those behind it, none other between."""
    return (F.col("last_label") == name) & (F.col("away") <= NEAR_PRICE) & F.col("kind").isin("label", "text") & F.col("value").rlike(r"^[\s:]*([A-Z]{3}\b)?[\s:]*[\d,.]*\s*$")


def _amount(value: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(value, MONEY, 2), r",|\.$", ""), F.lit("")).try_cast("decimal(18,2)")


def _currency(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"\b([A-Z]{3})\b", 1), F.lit(""))


def bidders(bodies: DataFrame) -> DataFrame:
    """Bidders of award bodies (notice_id, html): notice_id, role, place, name, reference, address, country, currency, price, reason.

    role: awardee, evaluated or rejected, whatever the order of the sections; place from 1 in its list.  The price is what
    stands behind a bidder up to the next: the contract price of awardees, the evaluated one of others.
    """
    r = _read(bodies).where("role IN ('awardee', 'evaluated', 'rejected') AND kind <> 'heading'")
    r = r.where("start_at > heading_at")
    wanted = F.when(F.col("role") == "awardee", _of_price("contract")).otherwise(_of_price("evaluated"))
    plain = F.lower(F.trim("value"))
    address = (F.col("kind").isin("text", "address")) & ~F.col("start") & ~F.col("reason") & ~F.coalesce("closed", F.lit(False)) & ~plain.isin("", *NO_ADDRESS)
    first = lambda value, when: F.min_by(F.when(when, value), F.when(when & value.isNotNull(), F.col("n")))
    head = F.col("value")
    found = r.groupBy("notice_id", "role", "bidder").agg(
        F.max(F.when(F.col("start"), head)).alias("head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(address, F.struct("n", "value")))), lambda x: x["value"]), "\n").alias("address"),
        F.coalesce(first(F.col("country"), F.col("kind") == "country"), F.lit("")).alias("country"),
        first(_currency(F.col("value")), wanted).alias("currency"),
        first(_amount(F.col("value")), wanted).alias("price"),
        F.coalesce(first(F.col("line"), F.col("reason")), F.lit("")).alias("reason"),
    )
    place = F.row_number().over(Window.partitionBy("notice_id", "role").orderBy("bidder"))
    return found.select(
        "notice_id", "role", place.alias("place"), F.trim(F.regexp_replace("head", REFERENCE, "")).alias("name"), F.regexp_extract("head", REFERENCE, 1).alias("reference"),
        "address", "country", "currency", "price", "reason",
    )


def summaries(bodies: DataFrame) -> DataFrame:
    """One row per award body: notice_id, supplier_name, _reference, _address, _country, currency, bid_price_opening, evaluated_price, contract_price, award_date, duration, useful.

    The supplier is the first awardee; where no firm is named (an individual) those columns are empty.  Of each price the
    first in the body counts, so the winner's where the awarded section is first; what the other template calls
    the amount is the contract price, its currency a name.  Useful: a supplier, a contract or an evaluated price.
    """
    r = _read(bodies).where("role <> 'none'")
    first = lambda value, when: F.min_by(F.when(when, value), F.when(when & value.isNotNull(), F.col("n")))
    value, away = F.col("value"), F.col("away")
    amount = (F.col("last_label") == "amount") & away.between(1, NEAR_AMOUNT) & F.col("kind").isin("text", "start")
    number = amount & F.col("line").rlike(rf"^{MONEY}")
    name = F.regexp_replace("line", r"^(.*?)\s*\((.*)\)$", "$1")
    echoed = F.lower(F.regexp_extract("line", r"^(.*?)\s*\((.*)\)$", 1)) == F.lower(F.trim(F.regexp_extract("line", r"^(.*?)\s*\((.*)\)$", 2)))
    money = F.substring(F.when(echoed & (name != ""), name).otherwise(F.col("line")), 1, 64)
    price = _of_price("opening") | _of_price("evaluated") | _of_price("contract")
    dated = (F.col("last_label") == "date") & away.between(0, NEAR_DATE)
    date = F.try_to_date(F.regexp_replace(F.regexp_extract("line", r"(\d{4}[/-]\d{1,2}[/-]\d{1,2})", 1), "/", "-"), "yyyy-M-d")
    lasting = (F.col("last_label") == "duration") & away.between(1, NEAR_DURATION) & (F.col("kind") == "text") & ~F.col("line").rlike(r"^\(.*\)$|:$")
    whole = r.groupBy("notice_id").agg(
        F.coalesce(first(_currency(value), price), first(money, amount & ~number), F.lit("")).alias("currency"),
        first(_amount(value), _of_price("opening")).alias("bid_price_opening"),
        first(_amount(value), _of_price("evaluated")).alias("evaluated_price"),
        F.coalesce(first(_amount(value), _of_price("contract")), first(_amount(F.col("line")), number)).alias("contract_price"),
        first(date, dated).alias("award_date"),
        F.coalesce(first(F.substring("line", 1, 64), lasting), F.lit("")).alias("duration"),
    )
    winner = bidders(bodies).where("role = 'awardee' AND place = 1").where(~F.lower(F.trim("name")).isin(*ANONYMOUS))
    winner = winner.select("notice_id", F.col("name").alias("supplier_name"), F.col("reference").alias("supplier_reference"), F.col("address").alias("supplier_address"), F.col("country").alias("supplier_country"))
    texts = ["supplier_name", "supplier_reference", "supplier_address", "supplier_country"]
    joined = bodies.select("notice_id").distinct().join(whole, "notice_id", "left").join(winner, "notice_id", "left").fillna("", [*texts, "currency", "duration"])
    useful = (F.col("supplier_name") != "") | (F.coalesce("contract_price", F.lit(0)) != 0) | (F.coalesce("evaluated_price", F.lit(0)) != 0)
    return joined.select("notice_id", *texts, "currency", "bid_price_opening", "evaluated_price", "contract_price", "award_date", "duration", useful.alias("useful"))
