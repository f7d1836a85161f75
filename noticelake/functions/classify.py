"""Rule classifiers as Columns: directions by weighted keywords, audience, questions, markers."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let

#: Keyword weights of each direction, in order of precedence on ties.
KEYWORDS = {
    "construction": {
        "construction of": 6, "civil works": 6, "rehabilitation of": 5, "reconstruction": 5, "road works": 5, "earthworks": 4, "building": 3, "bridge": 3,
        "pipeline": 3, "drilling": 3, "installation works": 4, "repair works": 4, "infrastructure": 2, "works contract": 5, "turnkey": 3, "irrigation": 2,
    },
    "consulting": {
        "consultancy": 6, "consulting serv": 6, "consultant": 5, "recruitment of": 5, "individual consultant": 6, "advisory": 4, "feasibility study": 5,
        "technical assistance": 5, "audit": 4, "design services": 4, "supervision services": 5, "training": 3, "study": 2, "assessment": 3,
        "expression of interest": 2, "capacity building": 3, "survey": 2, "evaluation": 2,
    },
    "supply": {
        "procurement of": 5, "supply of": 6, "supply and delivery": 6, "purchase of": 5, "goods": 3, "equipment": 4, "furniture": 4, "vehicles": 4,
        "medical equipment": 5, "laboratory equipment": 5, "spare parts": 4, "materials": 3, "machinery": 4, "delivery of": 3,
    },
    "it": {
        "software": 5, "information technology": 5, "it equipment": 5, "computer": 4, "hardware": 3, "network": 3, "data center": 5, "digital": 3, "erp": 4,
        "management information system": 5, "web portal": 4, "cyber": 3, "telecommunication": 4,
    },
    "services": {
        "non-consulting": 6, "catering": 4, "cleaning": 4, "security services": 5, "logistics": 3, "transportation serv": 4, "maintenance serv": 4,
        "insurance": 4, "printing": 3, "hotel": 3, "event": 2,
    },
}
#: Endings a keyword may have, method codes of consulting, groups that hint and that decide.
SUFFIXES = ("s", "es", "ed", "ing", "ings", "ion", "ions", "or", "ors", "er", "ers", "ure", "ures", "al", "ally", "ization", "izations", "isation", "isations", "ment", "ments")
METHODS = ("QCBS", "QBS", "CQS", "LCS", "FBS", "INDV", "SSS")
GROUPS = {"CS": "consulting", "GO": "supply", "CW": "construction", "NC": "services"}
DECIDES = {"CS": "consulting", "GO": "supply", "CW": "construction"}
FIRM_METHODS = ("CQS", "QCBS", "QBS", "LCS", "FBS")
FULL = 18  # fixed value: weight from which a score is not damped


def folded(text: Column) -> Column:
    """Lower case, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def pattern(keyword: str) -> str:
    return rf"\b{keyword}(?:{'|'.join(sorted(SUFFIXES, key=len, reverse=True))})?\b"


def has_keyword(keyword: str, text: Column) -> Column:
    """A phrase anywhere; a single word from its start, with a listed ending at most."""
    return F.contains(text, F.lit(keyword)) if " " in keyword else text.rlike(pattern(keyword))


def category(title: Column, body: Column, method: Column, group: Column, most_body: int = 4000) -> Column:
    """struct<category, confidence, runner_up> by keyword weights; a title hit counts twice.

    Method and group codes add 8 and 6.  A group that decides settles a dispute among the three
    directions that groups name.  Confidence is the share of all weight, damped below 18.
    """
    sides = F.struct(
        folded(title).alias("head"), F.substring(folded(body), 1, most_body).alias("rest"),
        F.upper(F.trim(F.coalesce(method, F.lit("")))).alias("m"), F.upper(F.trim(F.coalesce(group, F.lit("")))).alias("g"),
    )

    def scores(x: Column) -> Column:
        found = []
        for k, (name, words) in enumerate(KEYWORDS.items()):
            hits = [F.when(has_keyword(w, x["head"]), 2 * n).when(has_keyword(w, x["rest"]), n).otherwise(0) for w, n in words.items()]
            if name == "consulting":
                hits.append(F.when(x["m"].isin(*METHODS), 8).otherwise(0))
            hits += [F.when(x["g"] == code, 6).otherwise(0) for code, to in GROUPS.items() if to == name]
            found.append(F.struct(reduce(lambda a, b: a + b, hits).alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("name")))
        decided = F.coalesce(F.create_map(*[F.lit(v) for p in DECIDES.items() for v in p])[x["g"]], F.lit(""))
        return F.struct(F.filter(F.sort_array(F.array(*found), asc=False), lambda s: s["score"] > 0).alias("r"), decided.alias("decided"))

    def settle(x: Column) -> Column:
        r, winner = x["r"], F.get(x["r"], F.lit(0))["name"]
        name = F.when((x["decided"] != "") & winner.isin(*DECIDES.values()), x["decided"]).otherwise(winner)
        best = F.coalesce(F.get(F.filter(r, lambda s: s["name"] == name), F.lit(0))["score"], F.lit(0))
        total = F.aggregate(r, F.lit(0), lambda a, s: a + s["score"])
        sure = F.round(F.try_divide(best, total) * F.least(F.lit(1.0), best / FULL), 3)
        return F.struct(
            F.coalesce(name, F.lit("unknown")).alias("category"), F.coalesce(sure, F.lit(0.0)).alias("confidence"), F.get(r, F.lit(1))["name"].alias("runner_up")
        )

    # the texts are folded once, and the scores added up once
    return let(let(sides, scores), settle)


def category_sql(title: str, body: str, group: str) -> str:
    """The same for DuckDB, without method codes: category and confidence from table ``t``, one row an id."""
    scores = []
    for name, words in KEYWORDS.items():
        test = lambda w, c: f"contains({c}, '{w}')" if " " in w else f"regexp_matches({c}, '{pattern(w)}')"
        hits = [f"CASE WHEN {test(w, 'h')} THEN {2 * n} WHEN {test(w, 'b')} THEN {n} ELSE 0 END" for w, n in words.items()]
        hits += [f"CASE WHEN g = '{code}' THEN 6 ELSE 0 END" for code, to in GROUPS.items() if to == name]
        scores.append(f"{' + '.join(hits)} AS {name}")
    fold = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
    names = list(KEYWORDS)
    rank = ", ".join(f"({n}, {-k}, '{n}')" for k, n in enumerate(names))
    decided = "CASE g " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DECIDES.items()) + " END"
    return f"""
    f AS (SELECT id, {fold(title)} AS h, left({fold(body)}, 4000) AS b, {group} AS g FROM t), s AS (SELECT id, g, {', '.join(scores)} FROM f),
    w AS (SELECT *, list_sort([{rank}], 'DESC')[1] AS top, {' + '.join(names)} AS total FROM s),
    c AS (SELECT *, CASE WHEN total = 0 THEN 'unknown' WHEN {decided} IS NOT NULL AND top[3] IN ('consulting', 'supply', 'construction') THEN {decided} ELSE top[3] END AS category FROM w),
    best AS (SELECT id, category, total, CASE category {' '.join(f"WHEN '{n}' THEN {n}" for n in names)} ELSE 0 END AS score FROM c)"""


def audience(direction: Column, code: Column, name: Column) -> Column:
    """individual or firm for consulting, empty where the method leaves it open."""
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return (
        F.when(direction != "consulting", "").when(F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit("individual")), "individual")
        .when(c.isin(*FIRM_METHODS), "firm").otherwise("")
    )


#: Fixed value: confidence below which a rule asks the model.
UNSURE = 0.55


def escalate(rule: Column, confidence: Column, answer: Column) -> Column:
    """struct<label, decided_by, asked>: a sure rule stands; below UNSURE the model's answer does, and without one the rule again."""
    unsure = F.coalesce(confidence, F.lit(0.0)) < UNSURE
    model = F.nullif(F.trim(answer), F.lit(""))
    return F.struct(
        F.when(unsure, F.coalesce(model, rule)).otherwise(rule).alias("label"),
        F.when(unsure & model.isNotNull(), "model").otherwise("rule").alias("decided_by"),
        unsure.alias("asked"),
    )


#: Words of the question router in three languages, and words above which a question is long.
DEEP = (
    "compare", "comparison", "evaluate", "evaluation", "assess", "assessment", "analyse", "analyze", "analysis", "eligibility", "eligible", "qualify", "qualifies",
    "risk", "risks", "why", "difference", "differences", "trend", "trends", "recommend", "recommendation", "implication", "implications", "range", "typical",
    "typically", "average", "summarise", "summarize",
    "taqqosla", "taqqoslang", "solishtir", "solishtiring", "baho", "baholang", "tahlil", "xavf", "xavflar", "nega", "nima uchun", "farq", "farqi", "tavsiya", "odatda",
    "oʻrtacha", "ortacha", "muvofiq", "mos",
    "сравнить", "сравните", "сравнение", "оценить", "оцените", "оценка", "анализ", "проанализировать", "проанализируйте", "риск", "риски", "почему", "разница",
    "различия", "рекомендация", "порекомендуйте", "обычно", "средний", "соответствует", "соответствие", "диапазон",
)
FAST = (
    "contact", "email", "e-mail", "phone", "telephone", "address", "deadline", "closing", "date", "when", "who", "where", "country", "reference", "id", "title", "name",
    "language", "currency",
    "aloqa", "pochta", "email", "telefon", "manzil", "muddat", "muddati", "sana", "qachon", "kim", "kimning", "qayerda", "davlat", "raqam", "nomi",
    "контакт", "почта", "электронная", "телефон", "адрес", "срок", "дедлайн", "дата", "когда", "кто", "где", "страна", "номер", "название",
)
LONG_QUESTION = 25


def route(question: Column, scoped: Column | None = None, history: Column | None = None, deep: tuple[str, ...] = DEEP, fast: tuple[str, ...] = FAST) -> Column:
    """struct<tier, reason>: which tier answers a question, and the rule that said so.

    Analytic words win, then length.  A look-up word goes fast only where the question is ``scoped`` to one
    notice, as without one it reads across many; so does the opener of a scoped thread (``history`` 0).
    All else goes deep.  Words are whole and folded; forms are listed, not stemmed.
    """
    scope = F.coalesce(scoped, F.lit(False)) if scoped is not None else F.lit(False)
    turns = F.coalesce(history, F.lit(0)) if history is not None else F.lit(0)
    words = F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit(r"(?U)([^\W_]+)"), F.lit(1))

    def reason(w: Column) -> Column:
        of = lambda names: F.arrays_overlap(w, F.array(*[F.lit(x) for x in dict.fromkeys(names)]))
        return (
            F.when(of(deep), "analysis:word").when(F.size(w) > LONG_QUESTION, "analysis:length")
            .when(of(fast), F.when(scope, "lookup:word").otherwise("analysis:unscoped"))
            .when(scope & (turns == 0), "lookup:scoped_opener").otherwise("analysis:default")
        )

    return let(let(words, reason), lambda r: F.struct(F.when(r.startswith("lookup"), "fast").otherwise("deep").alias("tier"), r.alias("reason")))


#: Fixed value: language that is worth a reading for requirements; wider than the families below on purpose.
REQUIREMENT_LANGUAGE = (
    r"(?i)qualif|eligib|shall|must|required|requirement|minimum|at least|not less than|no less than|turnover|liquid asset|bid security|net worth|cash[-\s]?flow|certif|"
    r"licen[cs]|registration|accredit|experien|personnel|audited|financial statement|capabilit|capacit"
)
#: What tells that a sentence is about a key that rules read.
KEY_TOPICS = {
    "annual_turnover_avg": r"(?i)annual\s+(?:\w+\s+)?turnover",
    "liquid_assets": r"(?i)liquid assets|cash[-\s]?flow requirement",
    "similar_contracts_count": r"(?is)(?:participation|experience)\b.{0,200}?\bcontracts?\b|similar\s+(?:contracts?|nature)",
    "bid_security": r"(?i)bid security|bid[-\s]securing declaration",
}


def linear(pattern: str) -> str:
    """A pattern of MARKERS for engines that read a text in one pass: letters fold beyond ASCII without a flag, a look-ahead is a border."""
    return pattern.replace("(?iu)", "(?i)").replace(r"(?![\p{L}\d_])", r"(?:[^\p{L}\d_]|$)")


def marker_score(text: Column, families: dict[str, str]) -> Column:
    """How many families of patterns occur; null for null.

    Arrow's engine reads a text once a family, whatever the number of branches, where a backtracking one tries
    each of them at each character.
    """
    patterns = [linear(p) for p in families.values()]

    @F.arrow_udf("int")
    def score(texts: pa.Array) -> pa.Array:
        found = [pc.match_substring_regex(texts, p).cast(pa.int32()) for p in patterns]
        return reduce(pc.add, found)

    return score(text)


#: Families of requirement language, each with its Russian form.
MARKERS = {
    "qualification": r"(?iu)qualificat|квалификац",
    "eligibility": r"(?iu)eligib|критери[\p{L}\d_]*\s+отбора|соответстви[\p{L}\d_]+\s+требовани",
    "threshold": r"(?iu)\bat least\b|\bminimum\b|\bnot? less than\b|\bno fewer than\b|не\s+менее|как\s+минимум|не\s+ниже",
    "experience_years": (
        r"(?iu)\b\d{1,2}\+?\s*(?:\(\d{1,2}\)\s*)?years?\b|years?\s+of\s+(?:[\p{L}\d_]+\s+){0,2}experience"
        r"|\b\d{1,2}\s*(?:лет|год[аеу]?)(?![\p{L}\d_])|опыт[\p{L}\d_]*\s+работы|стаж[\p{L}\d_]*"
    ),
    "obligation": (
        r"(?iu)\b(?:shall|should|must)\s+(?:have|hold|possess|demonstrate|provide)\b|\brequirements?\b"
        r"|долж[\p{L}\d_]+\s+(?:иметь|обладать|располагать|владеть)|требовани[\p{L}\d_]+"
    ),
    "key_experts": (
        r"(?iu)key\s+experts?|key\s+staff|team\s+leader|proposed\s+(?:staff|personnel|experts?)"
        r"|ключев[\p{L}\d_]+\s+эксперт|руководител[\p{L}\d_]+\s+групп|состав[\p{L}\d_]*\s+специалист"
    ),
    "education": (
        r"(?iu)(?:master|bachelor|university|advanced|postgraduate)'?s?\s+degree|\bph\.?\s?d\b|\bm\.?sc\b|\bb\.?sc\b"
        r"|высш[\p{L}\d_]+\s+образовани|степен[\p{L}\d_]+\s+(?:магистра|бакалавра)|диплом[\p{L}\d_]*"
    ),
    "financial": (
        r"(?iu)turnover|liquid assets|financial (?:capacity|standing|capability)|audited (?:financial|accounts)|net worth"
        r"|годов[\p{L}\d_]+\s+оборот|финансов[\p{L}\d_]+\s+(?:состояни|устойчивост|отчетност)"
    ),
    "credential": r"(?iu)\biso\s*\d|certificat|accredit|licen[cs]e|registration\s+(?:with|as)|сертифика[\p{L}\d_]*|лицензи[\p{L}\d_]*|аккредит[\p{L}\d_]*",
    "shortlist": r"(?iu)short-?list|(?:корот|крат)к[\p{L}\d_]+\s+список",
}


def marker_sql(text: str) -> str:
    """The same count for DuckDB."""
    clean = lambda p: linear(p).replace("'", "''")
    return " + ".join(f"regexp_matches({text}, '{clean(p)}')::INT" for p in MARKERS.values())


#: Sub-directions of consulting, with the weight of each phrase.
SUBDIRECTIONS = {
    "engineering": {
        "supervision of works": 8, "construction supervision": 8, "works supervision": 8, "design and supervision": 8, "detailed design": 7,
        "engineering design": 7, "feasibility design": 6, "surveillance des travaux": 8, "supervision des travaux": 8, "etudes techniques": 7,
        "maitrise d oeuvre": 8, "supervision de obras": 8, "diseno": 5, "controle des travaux": 8, "surveillance": 5, "topograph": 6, "engenharia": 6,
        "supervisao": 6, "fiscalizacao de obras": 8, "travaux": 4, "obras": 4, "supervision": 5, "engineering": 5, "architect": 5, "topographic": 4,
        "geotechnical": 5, "structural": 4, "bill of quantities": 5, "technical design": 6,
    },
    "audit": {
        "external audit": 8, "financial audit": 8, "statutory audit": 8, "audit of the financial statements": 9, "internal audit": 7, "audit externe": 8,
        "audit financier": 8, "auditoria": 8, "audit des etats financiers": 9, "financial management": 6, "accounting": 5, "bookkeeping": 5, "audit": 5,
        "auditor": 6, "commissaire aux comptes": 8, "auditoria externa": 8, "contabilidade": 6,
    },
    "environment_social": {
        "environmental and social impact": 9, "environmental impact assessment": 9, "resettlement action plan": 9, "social safeguard": 8,
        "environmental and social": 7, "resettlement": 7, "etude d impact environnemental": 9,
        "plan de reinstallation": 8, "impacto ambiental": 8, "safeguard": 6, "environmental": 4, "gender": 4, "climate": 4, "biodiversity": 5, "grievance redress": 6,
    },
    "training": {
        "capacity building": 8, "training of trainers": 8, "training programme": 7, "training program": 7, "renforcement des capacites": 8, "formation": 5,
        "capacitacion": 7, "fortalecimiento de capacidades": 8, "training": 5, "curriculum": 6, "workshop": 4, "coaching": 5, "mentoring": 5,
        "e learning": 6, "capacitacao": 7, "formacao": 6, "encadrement": 6,
    },
    "research": {
        "feasibility study": 8, "baseline study": 8, "baseline survey": 8, "impact evaluation": 8, "monitoring and evaluation": 8, "household survey": 7,
        "market study": 7, "diagnostic study": 7, "etude de faisabilite": 8, "enquete": 5, "evaluation d impact": 8, "estudio de factibilidad": 8,
        "encuesta": 5, "ligne de base": 7, "linea de base": 7, "levantamiento": 6, "research": 5, "survey": 4, "assessment": 4, "study": 4,
        "data collection": 6, "analysis": 3, "etude": 4, "estudo": 4, "elaboration": 5, "elaboracao": 5, "diagnostico": 5,
    },
    "it_advisory": {
        "management information system": 8, "information system": 6, "software development": 7, "system integration": 6, "digital transformation": 7,
        "it consultancy": 8, "developpement logiciel": 7, "systeme d information": 7, "database design": 6, "erp": 5, "gis": 5, "cybersecurity": 6,
        "digital": 4, "software": 5, "informaticien": 7, "informatico": 6,
    },
    "legal_procurement": {
        "procurement specialist": 8, "procurement consultant": 8, "legal advisory": 8, "legal counsel": 7, "legal expert": 7, "contract management": 6,
        "regulatory reform": 6, "specialiste en passation des marches": 9, "conseil juridique": 7, "especialista en adquisiciones": 9,
        "asesoria legal": 8, "procurement agent": 8, "procurement advisory": 8, "legal advisor": 7, "legal services": 7, "regulatory": 5,
    },
    "management": {
        "project implementation unit": 8, "implementation support": 7, "project management support": 8, "project coordinator": 7, "technical assistance": 6,
        "institutional strengthening": 7, "appui a la mise en oeuvre": 8, "unite de gestion de projet": 8, "apoyo a la implementacion": 8,
        "project manager": 6, "coordination": 4, "advisory services": 5, "mise en oeuvre": 6, "assistance technique": 7, "asistencia tecnica": 7,
        "assistencia tecnica": 7, "apoio a ugp": 8, "gestion de projet": 6,
    },
}
SUB_FULL, SUB_FLOOR = 16, 0.18
ACCENTS = ("éèêàâôîïûçñãõáíóú", "eeeaaoiiucnaoaiou")  # œ and æ become two letters


def subdirection(direction: Column, title: Column, body: Column, most_body: int = 4000) -> Column:
    """struct<sub, confidence> of consulting notices, empty for other directions.

    A title hit counts twice; in the body only phrases of several words count.  Below the floor the
    sub-direction is ``other``.
    """
    plain = lambda c: folded(F.replace(F.replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), *ACCENTS), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae")))
    sides = F.struct(plain(title).alias("head"), F.substring(plain(body), 1, most_body).alias("rest"))

    def scores(x: Column) -> Column:
        found = []
        for k, (name, words) in enumerate(SUBDIRECTIONS.items()):
            hits = []
            for w, n in words.items():
                in_body = F.when(F.contains(x["rest"], F.lit(w)), n).otherwise(0) if " " in w else F.lit(0)
                hits.append(F.when(has_keyword(w, x["head"]), 2 * n).otherwise(in_body))
            found.append(F.struct(reduce(lambda a, b: a + b, hits).alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("name")))
        return F.array(*found)

    def settle(all_scores: Column) -> Column:
        best = F.array_max(all_scores)
        total = F.aggregate(all_scores, F.lit(0), lambda a, s: a + s["score"])
        sure = F.coalesce(F.round(F.try_divide(best["score"], total) * F.least(F.lit(1.0), best["score"] / SUB_FULL), 3), F.lit(0.0))
        return F.struct(F.when(sure < SUB_FLOOR, "other").otherwise(best["name"]).alias("sub"), sure.alias("confidence"))

    found = let(let(sides, scores), settle)
    none = F.struct(F.lit("").alias("sub"), F.lit(0.0).alias("confidence"))
    return F.when(direction == "consulting", found).otherwise(none)
