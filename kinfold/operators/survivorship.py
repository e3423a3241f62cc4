"""One canonical record a cluster: trust-weighted winners, unions, audit trail and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.functions.text import strip

_CLAIM = "struct<field:string,source:string,method:string,value:string,confidence:double,is_winner:boolean>"


def scalar_claims(members: DataFrame, fields: tuple[str, ...] = V.SCALARS) -> DataFrame:
    """Long form of the scalar fields: (cluster, fid, field, value, source, method, trust, score)."""
    claim = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f)["value"].alias("value"), F.col(f)["confidence"].alias("confidence")) for f in fields])
    rows = members.select("cluster", "fid", "source", "method", "trust", F.inline(claim)).filter("value IS NOT NULL")
    return rows.withColumn("score", F.col("trust") * F.col("confidence"))


def _rank() -> Column:
    """Orders claims: score, trust, value without case, place."""
    return F.struct((-F.col("score")).alias("s"), (-F.col("trust")).alias("t"), F.lower("value").alias("v"), F.col("fid").alias("f"), F.col("value").alias("value"))


def winners(claims: DataFrame) -> DataFrame:
    """(cluster, field, value, score) of the best claim; partial minima, so a hot cluster moves once a task.

    Agreement doesn't raise a score: the bonus is capped at a factor of one.
    """
    best = claims.groupBy("cluster", "field").agg(F.min(_rank()).alias("best"))
    return best.select("cluster", "field", F.col("best.value").alias("value"), (-F.col("best.s")).alias("score"))


def agreement(claims: DataFrame) -> DataFrame:
    """(cluster, field, value, n): how many claims agree without case."""
    return claims.groupBy("cluster", "field", F.lower(strip(F.col("value"))).alias("value")).agg(F.count("*").alias("n"))


def items(members: DataFrame) -> DataFrame:
    """Union of list values: (cluster, kind, key, score, sources, first) with each value once.

    first holds the fragment and place a value first stands at, and the experience or education entry there.
    """
    blank_e, blank_u = F.lit(None).cast(V.EXPERIENCE), F.lit(None).cast(V.EDUCATION)

    def listed(field: str, key, conf, exp=lambda x: blank_e, edu=lambda x: blank_u, bad=lambda x: F.lit(False)) -> Column:
        entry = lambda x, i: F.struct(F.lit(field).alias("kind"), key(x).alias("key"), (F.col("trust") * conf(x)).alias("score"), i.alias("i"), exp(x).alias("exp"), edu(x).alias("edu"), bad(x).alias("bad"))
        return F.coalesce(F.transform(F.col(field)["value"], entry), F.array().cast(f"array<struct<kind:string,key:string,score:double,i:int,exp:{V.EXPERIENCE},edu:{V.EDUCATION},bad:boolean>>"))

    whole = lambda f: lambda x: F.col(f)["confidence"]
    every = F.concat(
        listed("emails", lambda x: F.lower(strip(x)), whole("emails")),
        listed("phones", strip, whole("phones")),
        listed("skills", lambda x: strip(x["name"]), lambda x: x["confidence"]),
        listed("experience", lambda x: x["key"], whole("experience"), exp=lambda x: x["item"], bad=lambda x: x["bad"]),
        listed("education", lambda x: x["key"], whole("education"), edu=lambda x: x["item"], bad=lambda x: x["bad"]),
    )
    rows = members.select("cluster", "fid", "source", F.inline(every)).filter("kind IN ('experience', 'education') OR key <> ''")
    return rows.groupBy("cluster", "kind", "key").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"), F.min(F.struct("fid", "i", "exp", "edu", "bad")).alias("first"))


def _of(kind: str) -> Column:
    return F.filter("items", lambda x: x["kind"] == kind)


def _newest_first(entries: Column, order) -> Column:
    """Sorted by order, greatest first; equal ones keep their place."""

    def compare(a: Column, b: Column) -> Column:
        x, y = order(a), order(b)
        ahead = lambda p, q: reduce(lambda rest, i: F.when(p[i] > q[i], True).when(p[i] < q[i], False).otherwise(rest), reversed(range(len(p))), F.lit(None).cast("boolean"))
        first = ahead(x, y)
        return F.when(first, -1).when(~first, 1).when(a["first"]["fid"] != b["first"]["fid"], F.when(a["first"]["fid"] < b["first"]["fid"], -1).otherwise(1)).when(a["first"]["i"] < b["first"]["i"], -1).when(a["first"]["i"] > b["first"]["i"], 1).otherwise(0)

    return F.array_sort(entries, compare)


def weighted_confidence(scores: dict[str, Column]) -> Column:
    """Weighted mean of the scores that aren't null, summed in the fixed order of the weights, at most 1; none: 0."""
    zero = F.lit(0.0)
    total = reduce(lambda a, f: a + F.coalesce(scores[f] * V.FIELD_WEIGHTS[f], zero), [f for f in V.FIELD_WEIGHTS if f in scores], zero)
    weight = reduce(lambda a, f: a + F.when(scores[f].isNotNull(), V.FIELD_WEIGHTS[f]).otherwise(0.0), [f for f in V.FIELD_WEIGHTS if f in scores], zero)
    return F.when(weight > 0, F.least(F.lit(1.0), total / weight)).otherwise(0.0)


def candidate_id(emails: Column, phones: Column, name: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the strongest key."""
    seed = F.coalesce(F.concat(F.lit("email:"), F.get(emails, 0)), F.concat(F.lit("phone:"), F.get(phones, 0)), F.concat(F.lit("name:"), strip(F.lower(F.nullif(name, F.lit(""))))), F.lit("unknown"))
    return F.substring(F.sha2(seed, 256), 1, 16)


def provenance(members: DataFrame, best: DataFrame) -> DataFrame:
    """Every scalar claim, winners marked, and every skill claim: (cluster, order, entry)."""
    claims = scalar_claims(members).join(best.select("cluster", "field", F.col("value").alias("won"), F.col("score").alias("top")), ["cluster", "field"])
    entry = lambda field, value, score, won: F.struct(field.alias("field"), "source", "method", value.alias("value"), score.alias("confidence"), won.alias("is_winner")).cast(_CLAIM).alias("entry")
    field_order = F.array_position(F.array(*[F.lit(f) for f in V.SCALARS]), F.col("field")).cast("int")
    order = F.struct(field_order.alias("a"), (-F.col("score")).alias("b"), (-F.col("trust")).alias("c"), F.lower("value").alias("d"), F.col("fid").alias("e"))
    scalars = claims.select("cluster", order.alias("order"), entry(F.col("field"), F.col("value"), F.col("score"), (F.col("value") == F.col("won")) & (F.col("score") == F.col("top"))))
    skills = members.select("cluster", "fid", "source", "method", "trust", F.posexplode("skills.value").alias("i", "s")).filter(strip(F.col("s.name")) != "")
    place = F.struct(F.lit(len(V.SCALARS) + 1).alias("a"), F.col("fid").cast("double").alias("b"), F.col("i").cast("double").alias("c"), F.lit("").alias("d"), F.col("fid").alias("e"))
    name = strip(F.col("s.name"))
    return scalars.unionByName(skills.select("cluster", place.alias("order"), entry(F.concat(F.lit("skills."), name), name, F.col("trust") * F.col("s.confidence"), F.lit(True))))


def merge(members: DataFrame, with_provenance: bool = True) -> DataFrame:
    """Canonical records of fragments with a ``cluster`` column (a written table).

    Winners and unions are aggregates with a partial step; the audit trail, which needs every claim of a cluster in
    one row, is built only with_provenance. Clusters that take up a value of the wrong type are dropped.
    """
    best_loc = lambda c: F.min(F.when(c.isNotNull(), F.struct((-F.col("trust") * c["confidence"]).alias("s"), F.col("fid").alias("f"), c["value"].alias("value"))))
    scalar = lambda f: F.min(F.when(F.col(f).isNotNull(), F.struct((-F.col("trust") * F.col(f)["confidence"]).alias("s"), (-F.col("trust")).alias("t"), F.lower(F.col(f)["value"]).alias("v"), F.col("fid").alias("f"), F.col(f)["value"].alias("value"))))
    single = [*[scalar(f).alias(f) for f in V.SCALARS], *[best_loc(F.col(f)).alias(f) for f in ("location", *(f"location_{p}" for p in V.LOCATION_PARTS), *(f"link_{p}" for p in V.LINKS))]]
    best_list = [F.max(F.when(F.col(f).isNotNull(), F.col("trust") * F.col(f)["confidence"])).alias(f"{f}_score") for f in ("emails", "phones")]
    one = members.groupBy("cluster").agg(*single, *best_list)
    united = items(members).groupBy("cluster").agg(F.collect_list(F.struct("kind", "key", "score", "sources", "first")).alias("items"))
    both = one.join(united, "cluster", "left").withColumn("items", F.coalesce("items", F.array().cast(united.schema["items"].dataType)))

    keys = lambda kind: F.array_sort(F.transform(_of(kind), lambda x: x["key"]))
    skills = F.array_sort(F.transform(_of("skills"), lambda x: F.struct(x["key"].alias("name"), F.least(F.lit(1.0), x["score"]).alias("confidence"), x["sources"].alias("sources"))))
    empty = lambda c: F.coalesce(c, F.lit(""))
    experience = F.transform(_newest_first(_of("experience"), lambda x: [empty(x["first"]["exp"]["start"]), empty(x["first"]["exp"]["company"])]), lambda x: x["first"]["exp"])
    education = F.transform(_newest_first(_of("education"), lambda x: [F.coalesce(x["first"]["edu"]["end_year"], F.lit(0)), empty(x["first"]["edu"]["institution"])]), lambda x: x["first"]["edu"])
    text = F.col("location.value.text")
    parts = F.transform(F.split(text, ",", -1), strip)
    n = F.size(parts)
    some = lambda c: F.nullif(c, F.lit(""))
    told = {"city": some(F.get(parts, 0)), "region": F.when(n >= 3, some(F.get(parts, 1))), "country": F.when(n >= 2, some(F.element_at(parts, -1)))}
    place = {p: F.coalesce(F.when(text.isNotNull(), told[p]).otherwise(F.col(f"location.value.{p}")), some(strip(F.col(f"location_{p}.value")))) for p in V.LOCATION_PARTS}
    links = {p: some(strip(F.col(f"link_{p}.value"))) for p in V.LINKS}
    any_of = lambda cs: reduce(lambda a, b: a | b, [F.coalesce(c != "", F.lit(False)) for c in cs])
    bad = F.coalesce(F.col("location.value.bad"), F.lit(False)) | F.exists("items", lambda x: x["first"]["bad"])

    out = both.filter(~bad).select(
        "cluster",
        *[F.col(f)["value"].alias(f) for f in V.SCALARS],
        *[(-F.col(f)["s"]).alias(f"{f}_score") for f in V.SCALARS],
        keys("emails").alias("emails"),
        keys("phones").alias("phones"),
        "emails_score",
        "phones_score",
        F.when(any_of(place.values()), F.struct(*[c.alias(p) for p, c in place.items()])).alias("location"),
        F.coalesce(-F.col("location.s"), F.lit(V.LOCATION_PARTS_ONLY)).alias("location_score"),
        F.when(any_of(links.values()), F.struct(*[c.alias(p) for p, c in links.items()], F.array().cast("array<string>").alias("other"))).alias("links"),
        skills.alias("skills"),
        experience.alias("experience"),
        education.alias("education"),
    )
    scores = {f: F.col(f"{f}_score") for f in V.SCALARS}
    scores |= {f: F.when(F.size(f) > 0, F.col(f"{f}_score")) for f in ("emails", "phones")}
    scores |= {"skills": F.array_max(F.transform("skills", lambda s: s["confidence"])), "location": F.when(F.col("location").isNotNull(), F.col("location_score"))}
    record = out.withColumn("overall_confidence", weighted_confidence(scores)).withColumn("candidate_id", candidate_id(F.col("emails"), F.col("phones"), F.col("full_name")))
    record = record.withColumn("years_experience", F.col("years_experience").try_cast("double"))
    order = ["candidate_id", "full_name", "emails", "phones", "current_company", "title", "location", "links", "headline", "years_experience", "skills", "experience", "education"]
    if with_provenance:
        trail = provenance(members, winners(scalar_claims(members))).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "entry"))), lambda x: x["entry"]).alias("provenance"))
        record = record.join(trail, "cluster", "left").withColumn("provenance", F.coalesce("provenance", F.array().cast(f"array<{_CLAIM}>")))
        order.append("provenance")
    return record.select("cluster", *order, "overall_confidence")
