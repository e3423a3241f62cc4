"""Rows of each source to fragments: one wide row a person mention, a null struct for an absent field."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import vocabulary as V
from kinfold.functions.text import filled, first_group, number_at_least_zero, split_list, strip, words

# What free-text notes are searched for.
NOTE_EMAIL = r"(?U)\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
NOTE_PHONES = (r"(?U)\+?\d{1,3}[\s\-.]?\(?\d{2,4}\)?[\s\-.]?\d{3,4}[\s\-.]?\d{3,4}", r"(?U)\b\d{10}\b", r"(?U)\b\d{3}[\-.\s]\d{3}[\-.\s]\d{4}\b")
NOTE_NAMES = (
    r"(?iUd)(?:name|candidate|applicant)\s*[:=\-]\s*([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b",
    r"(?Ud)(?:[Ss]poke\s+(?:with|to)|[Mm]et|[Ii]nterviewed|[Rr]egarding|[Aa]bout)\s+([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b",
    r"(?Ud)(?:[Cc]hat\s+(?:with|w)|[Ii]ntro\s+call\s+(?:w|with)|[Mm]et)\s+([A-Z][a-z]+(?: \w+)?)\b",
    r"(?mUd)^([A-Z][a-z]+)\s+(?:reached\s+out|seems)\b",
)
NOTE_EMPLOYERS = (
    "Google|Gooogle|Microsoft|Microsofft|Amazon|Amazn|Apple|Meta|Facebook|Netflix|Uber|Airbnb|Stripe|Twitter|LinkedIn|Salesforce|Adobe|Oracle|IBM|Intel|Cisco|VMware|"
    "Atlassian|Shopify|Spotify|Tesla|SpaceX|Nvidia|TCS|Infosys|Wipro|HCL|Tech Mahindra|Cognizant|Accenture|Flipkart|Swiggy|Zomato|Razorpay|PhonePe|Ola|Myntra|Zoho|"
    "Freshworks|Paytm|Byju's|CRED|Meesho|Zerodha|Groww|Unacademy|Dream11|Nykaa|PolicyBazaar|ShareChat"
)
NOTE_COMPANIES = (
    r"(?iUd)(?:company|employer|works?\s+at|working\s+at|employed\s+at|current(?:ly)?\s+with|current(?:ly)?\s+at|been\s+at|somewhere\s+at)\s*[:=\-]?\s*([A-Z][\w\s&.,]+?)(?:\s+in\b|\s+for\b|\.|,|\n|$|(?=\s+for))",
    r"(?mUd)^([A-Z][a-z]+)\s+(?:currently|background)\b",
    rf"(?iUd)(?:from|at|with)\s+({NOTE_EMPLOYERS})\b",
)
NOTE_TITLES = (
    r"(?iUd)(?:title|role|position|designation)\s*[:=\-]\s*(.+?)(?:\.|,|\n|$)",
    r"(?iUd)(?:works?\s+as\s+(?:a\s+|an\s+)?|working\s+as\s+(?:a\s+|an\s+)?|currently\s+(?:a|an)\s+|doing\s+)(.+?)(?:\s+at\b|\s+in\b|\s+on\b|\s+for\b|\.|,|\n|$)",
    r"(?Ud)([A-Z][a-z\s]+?)\s+(?:profile|guy)\b",
)
NOTE_LOCATIONS = (
    r"(?iUd)(?:location|based\s+(?:out\s+of|in)|located\s+in|city)\s*[:=\-]?\s*([A-Z][\w\s,]+?)(?:\.|;|\n|$|\s+currently)",
    r"(?mUd)^([A-Z][a-z]+)\s+(?:based|location)\b",
    r"(?iUd)(?:from|in)\s+(Bangalore|Bengaluru|Mumbai|Delhi|Hyderabad|Chennai|Pune|Gurgaon|Noida)\b",
)
NOTE_SKILLS = (
    r"(?iUd)(?:skills?|technologies|tech\s+stack|proficient\s+in|experienced?\s+(?:in|with)|knows?|mention(?:ed|ing)|talked\s+(?:quite\s+a\s+bit\s+)?about|spoke\s+about|strong\s+in|comfortable\s+with)"
    r"\s*[:=\-]?\s*(.+?)(?:\s+(?:really|inside|very)\s|\s+well\b|\.\s|\.\s*$|\n|$|(?=\s+for))",
    r"(?imUd)^([A-Z][\w\s,]+?)(?:…|\.\.\.)",
)

#: Texts of which each match of a pattern holds one, in some case.
_NEEDS = {
    NOTE_NAMES[0]: ("name", "candidate", "applicant"), NOTE_NAMES[1]: ("spoke", "met", "interviewed", "regarding", "about"), NOTE_NAMES[2]: ("chat", "intro", "met"), NOTE_NAMES[3]: ("reached", "seems"),
    NOTE_COMPANIES[0]: ("company", "employe", "work", "current", "been", "somewhere"), NOTE_COMPANIES[1]: ("currently", "background"), NOTE_COMPANIES[2]: tuple(NOTE_EMPLOYERS.lower().split("|")),
    NOTE_TITLES[0]: ("title", "role", "position", "designation"), NOTE_TITLES[1]: ("work", "currently", "doing"), NOTE_TITLES[2]: ("profile", "guy"),
    NOTE_LOCATIONS[0]: ("location", "based", "located", "city"), NOTE_LOCATIONS[1]: ("based", "location"), NOTE_LOCATIONS[2]: ("bangalore", "bengaluru", "mumbai", "delhi", "hyderabad", "chennai", "pune", "gurgaon", "noida"),
    NOTE_SKILLS[0]: ("skill", "technologies", "stack", "proficient", "experience", "know", "mention", "about", "strong", "comfortable"), NOTE_SKILLS[1]: ("…", "..."),
}


def _fact(name: str, value: Column, confidence: float, present: Column | None = None) -> Column:
    kind = V.RAW_FIELDS[name]
    there = value.isNotNull() if present is None else present
    return F.when(there, F.struct(value.alias("value"), F.lit(confidence).alias("confidence")).cast(kind)).alias(name)


def _location(city=None, region=None, country=None, text=None, bad=None) -> Column:
    parts = {"city": city, "region": region, "country": country, "text": text}
    whole = [(F.lit(None).cast("string") if c is None else c).alias(k) for k, c in parts.items()]
    return F.struct(*whole, (F.lit(False) if bad is None else bad).alias("bad"))


def as_fragments(df: DataFrame, source: str, ord_col: str, facts: dict[str, Column]) -> DataFrame:
    """Fragments of one source: its keys, the given facts, absent ones as nulls; rows without any fact are dropped.

    fid numbers fragments in the order of ord_col: the source's rank in the high bits, then the row's place.
    """
    columns = [facts.get(f, F.lit(None).cast(kind)).alias(f) for f, kind in V.RAW_FIELDS.items()]
    keys = [F.lit(source).alias("source"), F.lit(V.SOURCE_TRUST[source]).alias("trust"), F.lit(V.SOURCE_METHOD[source]).alias("method")]
    # one generated row holds all facts, so that the filter reads them instead of working them out once more
    rows = df.select(F.col(ord_col).alias("ord"), *keys, F.inline(F.array(F.struct(*columns))))
    return rows.filter(reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in V.RAW_FIELDS]))


def number_fragments(frames: list[DataFrame], on_failure: Callable[[int, Exception], None] | None = None) -> DataFrame | None:
    """Union of sources in their order, with fid: the source's rank in the high bits, then the place in its order.

    Places come from a range sort and the row counts of the partitions before, so no task sees all rows. A source that
    fails while it is read is told to on_failure and left out; None if no source is left.
    """
    from kinfold.runtime import materialize

    out = []
    for rank, frame in enumerate(frames):
        try:
            ordered = materialize(frame.orderBy("ord").withColumn("mono", F.monotonically_increasing_id()), "ordered")
        except Exception as error:
            if on_failure is None:
                raise
            on_failure(rank, error)
            continue
        part = F.shiftright("mono", 33)
        sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
        before = {r.part: r.n for r in sizes.collect()}  # one number a partition
        starts, total = {}, 0
        for p in sorted(before):
            starts[p], total = total, total + before[p]
        offset = F.try_element_at(F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv]), part) if starts else F.lit(0)
        fid = F.lit(rank << 40) + offset + F.col("mono").bitwiseAND(F.lit((1 << 33) - 1))
        out.append(ordered.withColumn("fid", fid.cast("long")).drop("ord", "mono"))
    if not out:
        return None
    whole = reduce(DataFrame.unionByName, out)
    return whole.select("fid", *[c for c in whole.columns if c != "fid"])


def extract_csv(rows: DataFrame) -> DataFrame:
    """Fragments of (ord, cells): unknown headers are skipped; of two headers of one field the later column wins."""
    headers = lambda field: F.filter(F.map_keys("cells"), lambda k: k.isin(*V.CSV_HEADERS[field]))
    cell = lambda field: F.try_element_at("cells", F.try_element_at(headers(field), F.lit(-1)))
    conf = V.METHOD_CONFIDENCE["direct_field_read"]
    facts = {f: _fact(f, cell(f), conf) for f in ("full_name", "current_company", "title", "headline")}
    facts["years_experience"] = _fact("years_experience", number_at_least_zero(cell("years_experience")).cast("string"), conf)
    facts |= {f: _fact(f, split_list(cell(f)), conf) for f in ("emails", "phones")}
    facts["skills"] = _fact("skills", split_list(cell("skills"), "[,;|]"), conf)
    facts["location"] = _fact("location", F.when(cell("location").isNotNull(), _location(text=cell("location"))), conf)
    facts |= {f"location_{p}": _fact(f"location_{p}", cell(f"location.{p}"), conf) for p in V.LOCATION_PARTS}
    facts |= {f"link_{p}": _fact(f"link_{p}", cell(f"links.{p}"), conf) for p in ("linkedin", "github")}
    return as_fragments(rows, "csv", "ord", facts)


class Json:
    """Typed readings of one VARIANT value."""

    def __init__(self, v: Column):
        self.v = v
        self.kind = F.schema_of_variant(v)

    def get(self, path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(self.v, path, kind)

    @property
    def absent(self) -> Column:
        return self.v.isNull()

    @property
    def null(self) -> Column:
        return F.is_variant_null(self.v)

    def is_(self, *kinds: str) -> Column:
        return reduce(lambda a, b: a | b, [self.kind.startswith(k) for k in kinds])

    def text(self, parity: bool) -> Column:
        """As the text of a field: strings stripped, numbers and structures spelled out, an explicit null as "None"."""
        spelled = F.when(self.is_("BOOLEAN"), F.initcap(self.get("$", "string"))).otherwise(F.coalesce(self.get("$", "string"), F.to_json(self.v)))
        return F.when(self.null, F.lit("None" if parity else None).cast("string")).otherwise(filled(spelled))

    def list_(self, parity: bool) -> Column:
        """As a list of texts: items that aren't null, a text's comma-separated parts, or the value alone; null if empty."""
        items = F.transform(F.filter(self.get("$", "array<variant>"), lambda x: x.isNotNull() & ~F.is_variant_null(x)), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))
        found = F.when(self.is_("ARRAY"), items).otherwise(split_list(self.text(parity)))
        return F.when(F.size(found) > 0, found)


def _resolved(record: Json, key: str) -> Column:
    """The value at key, or at first_part.rest of a key with an underscore if the record lacks the key."""
    direct = record.get(f"$.{key}")
    first, _, rest = key.partition("_")
    if not rest:
        return direct
    nested = record.get(f"$.{first}.{rest}")
    return F.when(direct.isNotNull(), direct).otherwise(F.when(~F.is_variant_null(nested), nested))


def _history(v: Column, item: str, keys: tuple[str, str, str] | tuple[str, str]) -> Column:
    """array<struct<key, item, bad>> of the objects in a JSON list, in order."""

    def one(x: Column) -> Column:
        get = lambda k, kind="variant": F.try_variant_get(x, f"$.{k}", kind)
        raw = lambda k: F.when(F.is_variant_null(get(k)), "None").otherwise(F.coalesce(get(k, "string"), F.lit("")))
        not_text = lambda k: get(k).isNotNull() & ~F.is_variant_null(get(k)) & ~F.schema_of_variant(get(k)).startswith("STRING")
        key = F.lower(F.concat_ws("|", *[raw(k) for k in keys]))
        text = lambda k: F.when(~F.is_variant_null(get(k)), get(k, "string"))
        if item == V.EXPERIENCE:
            names = ("company", "title", "start", "end", "summary")
            body, bad = F.struct(*[text(k).alias(k) for k in names]), reduce(lambda a, b: a | b, [not_text(k) for k in names])
        else:
            year = F.when(F.schema_of_variant(get("end_year")).startswith("STRING"), F.when(strip(get("end_year", "string")).rlike(r"^[+-]?\d+\z"), strip(get("end_year", "string")).try_cast("int"))).otherwise(get("end_year", "double").try_cast("int"))
            study = F.coalesce(F.nullif(text("field"), F.lit("")), text("field_of_study"))
            body = F.struct(text("institution").alias("institution"), text("degree").alias("degree"), study.alias("field_of_study"), year.alias("end_year"))
            bad = not_text("institution") | not_text("degree")
        return F.struct(key.alias("key"), body.cast(item).alias("item"), F.coalesce(bad, F.lit(False)).alias("bad"))

    objects = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    return F.transform(objects, one)


def extract_ats(rows: DataFrame, strict_parity: bool = True) -> DataFrame:
    """Fragments of (ord, record): keys are tried in order, nested contact and employer blocks last.

    With strict_parity an explicit null under a mapped key reads as the text "None"; otherwise as absent.
    """
    record, conf, parity = Json(F.col("record")), V.METHOD_CONFIDENCE["ats_mapped"], strict_parity
    legs = lambda field: [Json(_resolved(record, k)) for k in V.ATS_KEYS[field]]
    nested = lambda path: Json(record.get(path))
    truthy = lambda j: F.when(~j.null & (~j.is_("BOOLEAN") | j.get("$", "boolean")) & (F.coalesce(j.get("$", "double"), F.lit(1.0)) != 0), j.text(False))
    text_of = lambda field: [j.text(parity) for j in legs(field)]
    facts: dict[str, Column] = {}
    for field in ("full_name", "headline"):
        facts[field] = _fact(field, F.coalesce(*text_of(field)), conf)
    employer = {"current_company": ("name", "company"), "title": ("title", "position")}
    for field, keys in employer.items():
        blocks_ = [truthy(nested(f"$.{b}.{k}")) for b in V.ATS_EMPLOYER_KEYS for k in keys]
        facts[field] = _fact(field, F.coalesce(*text_of(field), *blocks_), conf)
    contact = {"emails": ("email",), "phones": ("phone", "mobile"), "skills": ()}
    for field, keys in contact.items():
        facts[field] = _fact(field, F.coalesce(*[j.list_(parity) for j in legs(field)], *[nested(f"$.contact.{k}").list_(False) for k in keys]), conf)
    years = [F.when(j.is_("BOOLEAN"), j.get("$", "boolean").cast("double")).when(j.is_("STRING"), number_at_least_zero(j.get("$", "string"))).otherwise(j.get("$", "double")) for j in legs("years_experience")]
    facts["years_experience"] = _fact("years_experience", F.coalesce(*[F.when(y >= 0, y) for y in years]).cast("string"), conf)
    facts |= {f"link_{p}": _fact(f"link_{p}", F.coalesce(*text_of(f"links.{p}")), conf) for p in V.LINKS}
    parts = {p: F.coalesce(*reversed(text_of(f"location.{p}"))) for p in V.LOCATION_PARTS}
    plain = [j.is_("STRING", "VOID") | j.absent | (F.coalesce(j.text(parity), F.lit("")) == "") for p in V.LOCATION_PARTS for j in legs(f"location.{p}")]
    bad = ~reduce(lambda a, b: a & F.coalesce(b, F.lit(True)), plain, F.lit(True))
    facts["location"] = _fact("location", _location(**parts, bad=bad), conf, reduce(lambda a, b: a | b, [c.isNotNull() for c in parts.values()]))
    for field, item, keys in (("experience", V.EXPERIENCE, ("company", "title", "start")), ("education", V.EDUCATION, ("institution", "degree"))):
        flat = [F.when(~j.absent & (j.is_("ARRAY") | j.text(parity).isNotNull()), j.v) for j in legs(field)]
        own = record.get(f"$.{field}")
        inner = F.when(Json(own).is_("ARRAY") & (F.size(_history(own, item, keys)) > 0), own)
        value = F.coalesce(*flat, inner)
        facts[field] = _fact(field, F.coalesce(_history(value, item, keys), F.array().cast(f"array<struct<key:string,item:{item},bad:boolean>>")), conf, value.isNotNull())
    return as_fragments(rows, "ats_json", "ord", facts)


def _first_valid(text: Column, patterns: tuple[str, ...], valid, low: Column | None) -> Column:
    """The first match of each pattern in turn, until one passes."""
    found = [strip(first_group(text, p, _NEEDS[p], low)) for p in patterns]
    return F.get(F.filter(F.array(*found), lambda x: x.isNotNull() & valid(x)), 0)


def note_emails(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(NOTE_EMAIL), F.lit(0))
    return F.when(text.contains("@"), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def note_phones(text: Column) -> Column:
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in NOTE_PHONES]))
    some = F.array_distinct(F.filter(F.transform(found, strip), lambda x: x != ""))
    return F.when(text.rlike(r"(?U)\d{3}"), some).otherwise(F.array().cast("array<string>"))


def note_name(text: Column, low: Column | None = None) -> Column:
    first_line = lambda x: strip(F.substring_index(x, "\n", 1))
    valid = lambda x: F.size(words(first_line(x))).between(1, 4) & F.forall(words(first_line(x)), lambda w: w.rlike(r"^\p{L}+\z"))
    return first_line(_first_valid(text, NOTE_NAMES, valid, low))


def note_company(text: Column, low: Column | None = None) -> Column:
    return _first_valid(text, NOTE_COMPANIES, lambda x: F.size(words(x)).between(1, 6) & (F.char_length(x) <= 50), low)


def note_title(text: Column, low: Column | None = None) -> Column:
    return _first_valid(text, NOTE_TITLES, lambda x: F.size(words(x)).between(1, 8) & (F.char_length(x) <= 60), low)


def note_skills(text: Column, low: Column | None = None) -> Column:
    found = [F.coalesce(F.split(first_group(text, p, _NEEDS[p], low), r"(?U)[,;|]|\band\b", -1), F.array().cast("array<string>")) for p in NOTE_SKILLS]
    parts = F.transform(F.flatten(F.array(*found)), strip)
    return F.array_distinct(F.filter(parts, lambda x: F.char_length(x).between(1, 30)))


def note_location(text: Column, low: Column | None = None) -> Column:
    """struct of city, region, country: first, second of three or more, last of two or more comma-separated parts."""
    raw = F.coalesce(*[strip(first_group(text, p, _NEEDS[p], low)) for p in NOTE_LOCATIONS])

    def place(x: Column) -> Column:
        parts = F.transform(F.split(x, ",", -1), strip)
        n = F.size(parts)
        return _location(city=F.get(parts, 0), region=F.when(n >= 3, F.get(parts, 1)), country=F.when(n >= 2, F.element_at(parts, -1)))

    return F.get(F.transform(F.filter(F.array(raw), lambda x: x.isNotNull()), place), 0)


def extract_notes(rows: DataFrame) -> DataFrame:
    """Fragments of (ord, raw_text): only what a pattern finds, at the pattern's confidence."""
    # a column of its own, since each guard would work it out again
    rows = rows.withColumn("low_", F.lower("raw_text"))
    text, low, base = F.col("raw_text"), F.col("low_"), V.METHOD_CONFIDENCE["regex_extracted"]
    conf = {f: base * x for f, x in V.NOTE_FACTORS.items()}
    some = lambda c: F.when(F.size(c) > 0, c)
    found = {"emails": some(note_emails(text)), "phones": some(note_phones(text)), "full_name": note_name(text, low), "current_company": note_company(text, low), "title": note_title(text, low), "skills": some(note_skills(text, low)), "location": note_location(text, low)}
    return as_fragments(rows.filter(strip(text) != ""), "recruiter_notes", "ord", {f: _fact(f, v, conf[f]) for f, v in found.items()})


#: Extractors by source, beside kinfold.sources.readers.READERS.
EXTRACTORS = {"csv": extract_csv, "ats_json": extract_ats, "recruiter_notes": extract_notes}
