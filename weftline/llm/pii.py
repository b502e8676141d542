"""Surrogates for personal data (operator 2), with DataFrame functions only.

One regular expression finds e-mail addresses, phone numbers, card numbers, social security numbers, IP
addresses, bank account numbers, secrets and titled names.  Each match is taken apart into keys (an address
into local part and domain, a name into given and family name, a phone number into country code and the rest), so
that equal parts get equal surrogates wherever they stand: coreference holds across documents, spellings in
capitals and separators.  In a document with a titled name, later mentions without the title (given and family name, or
the family name alone) are replaced too.

A surrogate follows from HMAC-like SHA-256 digests of the secret key, the kind and the normalised value.  It
keeps kind and format: digits become digits, letters become letters of their script in the same case,
separators stay, country codes stay, card numbers that pass the Luhn check get surrogates that pass it, octets
keep their number of digits, given names keep the gender that titles tell anywhere in the corpus (neutral if they
differ).  Names have any number of words, of which the last is the family name; hyphened pieces are keyed apart.

Distinct keys get distinct surrogates, and no surrogate equals a detected value of its kind: candidates that collide
are drawn again.  Names, addresses and secrets may grow by a few characters after ``LONGER_FROM`` tries.  Numbers do
not: if their space is nearly used up, the keys left after ``NUMBER_TRIES`` tries, which share a format, take each
other's values in a keyed order, so that they stay distinct and none keeps its own.

Only texts with a match are shuffled.  Rows are addressed by doc_id and a hash of the text.

Defined cases: a null text stays null, an empty or clean text stays as it is; repeated rows get equal
surrogates; an empty table gives no rows; other columns pass through; result columns ``n_entities`` replaces a
column of the same name.
"""

from __future__ import annotations

import secrets
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, let, maybe_broadcast, possible, shared_dir

#: Replace it by a secret of your own: whoever has the key can test guesses.
DEFAULT_KEY = "change-me"
LONGER_FROM = 4
NUMBER_TRIES = 6
MAX_TRIES = 40
#: Kinds whose surrogates keep their length.
NUMBERS = ["phone", "card", "ssn", "ip", "iban"]

# Titles, by the gender they tell.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Mister", "Господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Госпожа"]
NEUTRAL_TITLES = ["Dr", "Prof"]
GIVEN = ["given_m", "given_f", "given_n"]
_TITLES = "|".join(MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES)

# A name is any number of words in a row: capitals inside, apostrophes and hyphens (not a contraction), all
# capitals, initials, and the small words between them.  The last word is the family name.
PARTICLES = ["van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "ten", "ter", "zu", "zur", "bin", "ibn", "al", "el"]
_GAP = r"[ \t\u00A0\u202F]+"
_TITLE = rf"(?:{_TITLES})\.?"
_SHORT = r"(?:[sdmSDM]|ll|re|ve|LL|RE|VE)(?!\p{L})"
_WORD = rf"\p{{Lu}}[\p{{L}}\p{{M}}]++(?:['’](?!{_SHORT})\p{{L}}[\p{{L}}\p{{M}}]*+|-(?:\p{{Ll}}{{1,3}}-)?\p{{Lu}}[\p{{L}}\p{{M}}]*+)*+|\p{{Lu}}['’]\p{{L}}[\p{{L}}\p{{M}}]++(?:-\p{{Lu}}[\p{{L}}\p{{M}}]*+)*+"
_SMALL = rf"(?:(?:{'|'.join(PARTICLES)}){_GAP})*+"
_INITIAL = rf"(?:\p{{Lu}}\.)++(?={_GAP}{_SMALL}\p{{Lu}}|\p{{Lu}}\p{{Ll}})|\p{{Lu}}(?={_GAP}{_SMALL}\p{{Lu}}[\p{{L}}'’])"
_NAMED = rf"(?:{_WORD}|{_INITIAL})"
# Repeated groups are possessive throughout: for others Java goes one call deeper for each repetition, and a few thousand
# end the executor by a stack overflow.  Where a match has to end before the last repetition, a look ahead says so.
_TITLED = rf"{_TITLE}{_GAP}(?:{_TITLE}{_GAP}(?={_SMALL}{_NAMED}))*+"

# Country calling codes of one and two digits; all others have three.
CALLING = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

_LOCAL = r"[\p{L}\p{N}._%+-]"
# Labels of a mail domain; the address ends with the last one that begins with two letters, after these.
_LABEL = r"[\p{L}\p{N}-]"
_OTHER_LABELS = rf"(?:\.(?!\p{{L}}{{2}}){_LABEL}++)*+"
PATTERNS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@{_LABEL}++(?:{_OTHER_LABELS}\.\p{{L}}{{2}}{_LABEL}*+(?={_OTHER_LABELS}\.\p{{L}}{{2}}))*+{_OTHER_LABELS}\.\p{{L}}{{2,}}+",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\p{L}\p{N}+.-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\p{N}-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\p{L}\p{N}])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "secret": r"(?<![\p{L}\p{N}])[0-9A-Fa-f]{32,128}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "name": rf"(?<!\p{{L}}){_TITLED}{_SMALL}{_NAMED}(?:(?:{_GAP}{_SMALL}|(?<=\.)){_NAMED})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text with none of these characters or parts of titles has no match; a search for fixed parts is cheap.
_HINT_CHARS = r"[0-9@]"
_HINT_PARTS = ["Mr", "Ms", "Mi", "Mons", "Mad", "Herr", "Frau", "Señor", "Госп", "Dr", "Prof"]

# Alphabets and syllables from which surrogates are made.
_ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "other": "一二三四五六七八九十百千万"}
_SYLLABLES = {
    "latin": ["ba", "do", "fe", "gi", "ka", "le", "mi", "no", "pa", "ra", "se", "ti", "va", "zo", "lu", "ne"],
    "cyrillic": ["ба", "до", "фе", "ги", "ка", "ле", "ми", "но", "па", "ра", "се", "ти", "ва", "зо", "лу", "не"],
    "greek": ["βα", "δο", "φε", "γι", "κα", "λε", "μι", "νο", "πα", "ρα", "σε", "τι", "βα", "ζο", "λυ", "νε"],
}
_ENDINGS = {
    "latin": {"given_m": ["n", "rd", "s", "ck"], "given_f": ["lla", "na", "ria", "ssa"], "given_n": ["n", "ry", "l", "m"], "family": ["nt", "rson", "lden", "ck"]},
    "cyrillic": {"given_m": ["н", "р", "с", "к"], "given_f": ["лла", "на", "рия", "са"], "given_n": ["н", "ри", "л", "м"], "family": ["нко", "рский", "лев", "к"]},
    "greek": {"given_m": ["νος", "ρης", "σος", "κης"], "given_f": ["λλα", "να", "ρια", "σσα"], "given_n": ["ν", "ρι", "λ", "μ"], "family": ["ντης", "ρου", "λας", "κος"]},
}


def matches(text: Column) -> Column:
    """All matches in a text, in order; null for a null text."""
    hint = text.rlike(_HINT_CHARS)
    for part in _HINT_PARTS:
        hint = hint | text.contains(part)
    return F.when(hint, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>"))


def _kind(match: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed([(k, p) for k, p in PATTERNS.items() if k != "name"]):
        out = F.when(match.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _parts(found: DataFrame) -> DataFrame:
    """(match) to (match, at, key kind or null for text that stays, raw)."""
    m = F.col("match")
    stays = F.lit(None).cast("string")

    def part(kind, raw):
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), raw.alias("raw"))

    # titles, then words and what stands between them; a given name's kind is settled over all matches, see _settle
    lead = F.regexp_extract(m, rf"^{_TITLE}{_GAP}(?:{_TITLE}{_GAP})*+", 0)
    titles = F.regexp_extract_all(lead, F.lit(rf"({_TITLES})"), F.lit(1))
    male, female = F.arrays_overlap(titles, F.array(*map(F.lit, MALE_TITLES))), F.arrays_overlap(titles, F.array(*map(F.lit, FEMALE_TITLES)))
    gender = F.when(male & ~female, "given_m").when(female & ~male, "given_f").otherwise("given_n")
    is_name = lambda w: w.rlike(r"^\p{L}") & ~w.isin(PARTICLES)
    # the last word with all of its hyphened pieces is the family name
    before_last = F.length(F.regexp_extract(m, rf"^(.*[ \t\u00A0\u202F.])[^ \t\u00A0\u202F.]+$", 1)) - F.length(lead)
    split_up = lambda name: F.regexp_extract_all(name, F.lit(r"[^ \t\u00A0\u202F.-]+|[ \t\u00A0\u202F.-]+"), F.lit(0))
    rest = F.substr(m, F.length(lead) + 1)
    # where it begins is found once for a name: names may have thousands of words
    at_last = F.size(split_up(F.substr(rest, F.lit(1), F.greatest(before_last, F.lit(0)))))
    words = let(F.struct(split_up(rest).alias("all"), at_last.alias("last"), gender.alias("given")), lambda x: F.transform(x["all"], lambda w, i: part(F.when(is_name(w), F.when(i >= x["last"], "family").otherwise(x["given"])), w)))
    named = F.concat(F.array(part(stays, lead)), words)
    code = F.regexp_extract(m, f"^{CALLING}", 0)
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    stem, top = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1), F.regexp_extract(domain, r"\.[^.]+$", 0)
    parts = (
        F.when(_is("email"), F.array(part("local", local), part(stays, F.lit("@")), part("domain", stem), part(stays, top)))
        .when(_is("name"), named)
        .when(_is("phone"), F.array(part(stays, code), part("phone", F.substr(m, F.length(code) + 1))))
        .when(_is("iban"), F.array(part(stays, F.substr(m, F.lit(1), F.lit(2))), part("iban", F.substr(m, F.lit(3)))))
        .otherwise(F.array(part(F.col("kind"), m)))
    )
    kinds = found.withColumn("kind", _kind(m))
    return kinds.select("match", F.posexplode(parts).alias("at", "part")).select("match", "at", "part.kind", "part.raw")


def _norm(kind: Column, raw: Column) -> Column:
    """What makes two spellings the same entity."""
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(raw, r"\D", "")).when(kind == "iban", F.replace(raw, F.lit(" "), F.lit(""))).when(kind.isin(GIVEN + ["family"]), F.lower(F.replace(raw, F.lit("’"), F.lit("'")))).otherwise(F.lower(raw))


def _settle(parts: DataFrame) -> DataFrame:
    """One kind for each given name: the gender that titles tell anywhere in the corpus, neutral if they differ or tell none."""
    given = parts.filter(F.col("kind").isin(GIVEN))
    told = given.groupBy("norm").agg(F.max((F.col("kind") == "given_m").cast("int")).alias("m"), F.max((F.col("kind") == "given_f").cast("int")).alias("f"))
    settled = told.select("norm", F.when(F.col("m") > F.col("f"), "given_m").when(F.col("f") > F.col("m"), "given_f").otherwise("given_n").alias("__kind"))
    joined = given.join(settled, "norm").withColumn("kind", F.col("__kind")).select(*parts.columns)
    return joined.unionByName(parts.filter(~F.coalesce(F.col("kind").isin(GIVEN), F.lit(False))))


def _space(kind: Column) -> Column:
    """Kinds within which surrogates differ: given names of all genders are one."""
    return F.when(kind.isin(GIVEN), "given").otherwise(kind)


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").when(c.rlike(r"\p{IsLatin}"), "latin").otherwise("other")


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(choices: list[str] | str, n: Column) -> Column:
    if isinstance(choices, str):
        return F.substr(F.lit(choices), (n % len(choices) + 1).cast("int"), F.lit(1))
    return F.get(F.array(*map(F.lit, choices)), n % len(choices))


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum with the last digit's place counted as the check digit's."""
    places = F.reverse(F.filter(F.split(digits, ""), lambda d: d != ""))
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _candidate(key: str) -> Column:
    """Surrogate of the normalised value in ``norm`` for the kind and try at hand."""
    kind, norm, attempt = F.col("kind"), F.col("norm"), F.col("attempt")
    longer = F.greatest(attempt - F.when(kind.isin(NUMBERS), NUMBER_TRIES).otherwise(LONGER_FROM - 1), F.lit(0))
    seed = F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(norm) + longer) / 32).cast("int")), lambda b: F.sha2(F.concat_ws("|", seed, b.cast("string"), F.lit(key)), 256))
    stream = F.array_join(blocks, "")
    chars = F.filter(F.split(F.concat(norm, F.substr(F.repeat(F.when(kind.isin("phone", "card", "ssn", "iban"), "7").when(kind == "secret", "a").otherwise("q"), MAX_TRIES), F.lit(1), longer.cast("int"))), ""), lambda c: c != "")

    def swap(c: Column, i: Column, drawn: Column) -> Column:
        b = _byte(drawn, i)
        letter = F.when(c.rlike("[a-z]"), _pick(_ALPHABETS["latin"], b))
        for script, alphabet in _ALPHABETS.items():
            letter = letter.when(_script(c) == script, _pick(alphabet, b))
        upper = F.when(kind == "iban", F.upper(letter)).otherwise(letter)
        return F.when(c.rlike(r"\p{N}"), F.when((i == 0) & (c != "0"), b % 9 + 1).otherwise(b % 10).cast("string")).when(c.rlike(r"\p{L}"), upper).otherwise(c)

    # the stream is made once for a value: in the lambda over its characters it would be made for each
    swapped = let(stream, lambda drawn: F.array_join(F.transform(chars, lambda c, i: swap(c, i, drawn)), ""))
    hexed = let(stream, lambda drawn: F.array_join(F.transform(chars, lambda c, i: F.substr(F.lit("0123456789abcdef"), _byte(drawn, i) % 16 + 1, F.lit(1))), ""))
    # the last digit of a valid card number is chosen so that the surrogate is valid too
    head = F.substr(swapped, F.lit(1), F.length(swapped) - 1)
    check = (10 - _luhn_sum(F.concat(head, F.lit("0"))) % 10) % 10
    card = F.when(_luhn_sum(norm) % 10 == 0, F.concat(head, check.cast("string"))).otherwise(swapped)

    def octet(o: Column, i: Column) -> Column:
        n = _byte(stream, 2 * i) * 256 + _byte(stream, 2 * i + 1)
        digits = F.length(o) + longer
        return F.when(digits == 1, n % 9 + 1).when(digits == 2, n % 90 + 10).otherwise(n % 156 + 100).cast("string")

    ip = F.array_join(F.transform(F.split(norm, r"\."), octet), ".")
    script = _script(norm)

    def spoken(where: str, ending: str) -> Column:
        n = F.when(kind == "family", 2).otherwise(1) + _byte(stream, F.lit(0)) % 2 + longer
        body = F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: _pick(_SYLLABLES[where], _byte(stream, i % 30))), "")
        return F.concat(body, _pick(_ENDINGS[where][ending], _byte(stream, F.lit(31))))

    name = F.lit(None).cast("string")
    for ending in ("given_m", "given_f", "given_n", "family"):
        of_script = F.when(script == "cyrillic", spoken("cyrillic", ending)).when(script == "greek", spoken("greek", ending)).otherwise(spoken("latin", ending))
        name = F.when(kind == ending, of_script).otherwise(name)
    return F.when(kind == "secret", hexed).when(kind == "card", card).when(kind == "ip", ip).when(kind.isin("given_m", "given_f", "given_n", "family"), name).otherwise(swapped)


#: Setting of the session that holds the secret of the surrogates.
KEY_SETTING = "spark.weftline.pii.key"
#: Secrets drawn for sessions on a cluster that name none, by application.
_DRAWN: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The secret that the session names; without one a known one where Spark runs on one machine, on a cluster one drawn for the application.

    With a drawn secret surrogates agree within the application only, and nobody can test guesses.
    """
    named = spark.conf.get(KEY_SETTING, None)
    if named or spark.sparkContext.master.startswith("local"):
        return named or DEFAULT_KEY
    application = spark.sparkContext.applicationId
    if application not in _DRAWN:
        warnings.warn(f"{KEY_SETTING} names no secret: surrogates agree within this application only", stacklevel=2)
    return _DRAWN.setdefault(application, secrets.token_hex(32))


def surrogates(keys: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(kind, norm) to (kind, norm, core): distinct cores within a kind, none of them a norm of that kind, or see ``_exchanged``."""
    spark = keys.sparkSession
    keys = cut(keys.distinct())
    norms = keys.select(_space(F.col("kind")).alias("space"), F.col("norm").alias("core"))
    # each round adds its rows to a folder that is read again: a union of checkpoints under a join can fail in Spark's
    # optimizer, which carries conditions of their rows over to columns that they no longer have
    path = f"{shared_dir(spark).rstrip('/')}/surrogates-{uuid.uuid4().hex}"

    def add(rows: DataFrame) -> DataFrame:
        rows.select("kind", "norm", "core").write.mode("append").parquet(path)
        return spark.read.schema("kind string, norm string, core string").parquet(path)

    open_keys, done = keys, None
    for attempt in range(MAX_TRIES):
        tried = cut(open_keys.withColumn("attempt", F.lit(attempt)).withColumn("core", _candidate(key)).withColumn("space", _space(F.col("kind"))))
        first = F.row_number().over(Window.partitionBy("space", "core").orderBy("norm", "kind")) == 1
        won = tried.withColumn("first", first).filter("first").join(norms, ["space", "core"], "left_anti")
        if done is not None:
            won = won.join(done.select(_space(F.col("kind")).alias("space"), "core"), ["space", "core"], "left_anti")
        done = add(won)
        open_keys = cut(open_keys.join(done, ["kind", "norm"], "left_anti"))
        if open_keys.isEmpty():
            return done
        if attempt == NUMBER_TRIES:
            done = add(_exchanged(open_keys.filter(F.col("kind").isin(NUMBERS)), key))
            open_keys = cut(open_keys.join(done, ["kind", "norm"], "left_anti"))
    raise RuntimeError("surrogates did not become distinct")


def _exchanged(keys: DataFrame, key: str) -> DataFrame:
    """Keys of one format take each other's norms, each that of the next in a keyed order; one alone is left out.

    Keys are left for this only if their format has hardly more values than there are keys, so a format's keys are few.
    """
    luhn = F.when(F.col("kind") == "card", _luhn_sum(F.col("norm")) % 10 == 0).otherwise(F.lit(False))
    shape = F.regexp_replace(F.regexp_replace("norm", r"\p{N}", "9"), r"\p{L}", "a")
    marked = keys.withColumn("shape", F.concat(shape, luhn.cast("string"))).withColumn("turn", F.sha2(F.concat_ws("|", F.lit(key), "norm"), 256))
    order = Window.partitionBy("kind", "shape").orderBy("turn")
    following = F.coalesce(F.lead("norm").over(order), F.first("norm").over(order))
    return marked.withColumn("core", following).filter("core <> norm").select("kind", "norm", "core")


def _render(kind: Column, raw: Column, core: Column) -> Column:
    """The surrogate in the spelling of the original: its separators and its capitals."""
    digits = kind.isin("phone", "card", "ssn", "iban")
    mold = F.filter(F.split(raw, ""), lambda c: c != "")
    # numbers: the n-th alphanumeric of the original gives way to the n-th of the surrogate
    n_before = lambda i: F.length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
    filled = F.concat(F.array_join(F.transform(mold, lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), F.substr(core, n_before(i), F.lit(1))).otherwise(c)), ""), F.substr(core, F.length(F.regexp_replace(raw, r"[^\p{L}\p{N}]", "")) + 1))
    cased = F.array_join(F.transform(F.filter(F.split(core, ""), lambda c: c != ""), lambda c, i: F.when(F.coalesce(F.get(mold, i), F.lit("")).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    capitals = (F.upper(raw) == raw) & (F.lower(raw) != raw) & (F.length(raw) > 1)
    named = F.when(capitals, F.upper(core)).otherwise(F.initcap(core))
    cased = F.when(capitals, F.upper(core)).otherwise(cased)
    return F.when(digits, filled).when(kind.isin("given_m", "given_f", "given_n", "family"), named).otherwise(cased)


def replacements(found: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """Distinct matches (column match) to (match, surrogate, mentions): of names, what later mentions of them become."""
    parts = cut(_settle(cut(_parts(found).withColumn("norm", _norm(F.col("kind"), F.col("raw"))))))
    cores = surrogates(parts.filter("kind is not null").select("kind", "norm"), key)
    # one part (a mail domain) may stand in a third of all matches: its side is one row, and AQE splits the other
    joined = parts.join(cores, ["kind", "norm"], "left")
    spelled = joined.withColumn("piece", F.when(F.col("core").isNull(), F.col("raw")).otherwise(_render(F.col("kind"), F.col("raw"), F.col("core"))))
    pieces = spelled.groupBy("match").agg(
        F.sort_array(F.collect_list(F.struct("at", "piece", "raw"))).alias("pieces"),
        F.min(F.when(F.col("kind") == "family", F.col("at"))).alias("family_at"),
    )

    def mention(begin: Column) -> Column:
        own = F.filter("pieces", lambda x: x["at"] >= begin)
        return F.struct(F.array_join(F.transform(own, lambda x: x["raw"]), "").alias("raw"), F.array_join(F.transform(own, lambda x: x["piece"]), "").alias("piece"))

    # the whole name without its title, then the family name alone; short ones may be words
    both = F.filter(F.array(mention(F.lit(1)), mention(F.col("family_at"))), lambda x: F.length(x["raw"]) >= 3)
    mentions = F.when(F.col("family_at").isNotNull(), both)
    return pieces.select("match", F.array_join("pieces.piece", "").alias("surrogate"), mentions.alias("mentions"))


def pseudonymize(docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with surrogates in ``text_col``, and ``n_entities`` (matches and later mentions)."""
    columns = [c for c in docs.columns if c.lower() != "n_entities"]
    text = F.col(text_col)
    keyed = docs.select(*columns).withColumn("__th", F.xxhash64(text))
    # texts are searched once; what is found is kept with the row's key
    hits = keyed.select(F.col("doc_id").alias("__id"), F.col("__th").alias("__th2"), matches(text).alias("__found"))
    hits = cut(hits.filter(F.size("__found") > 0).distinct())
    pairs = hits.select("__id", "__th2", F.explode(F.array_distinct("__found")).alias("match"))
    spelled = cut(replacements(pairs.select("match").distinct(), key))
    named = pairs.join(maybe_broadcast(spelled), "match")
    maps = named.groupBy("__id", "__th2").agg(
        F.map_from_entries(F.collect_list(F.struct("match", "surrogate"))).alias("__map"),
        F.array_sort(F.flatten(F.collect_list(F.coalesce("mentions", F.array().cast("array<struct<raw:string,piece:string>>"))))).alias("__mentions"),
    )
    once = F.filter("__mentions", lambda x, i: (i == 0) | (x["raw"] != F.get("__mentions", i - 1)["raw"]))
    maps = maps.withColumn("__mentions", once)
    of_doc = F.xxhash64("__id", "__th2")
    likely = possible(keyed, F.xxhash64("doc_id", "__th"), hits, of_doc)
    clean = likely.filter(~F.col("__maybe")).withColumn("n_entities", F.lit(0).cast("long"))
    found = hits.join(maps.withColumnsRenamed({"__id": "__id3", "__th2": "__th3"}), F.col("__id").eqNullSafe(F.col("__id3")) & (F.col("__th2") == F.col("__th3"))).drop("__id3", "__th3")
    rest = likely.filter("__maybe")
    joined = rest.join(found, rest["doc_id"].eqNullSafe(found["__id"]) & (rest["__th"] == found["__th2"]), "left")
    # longer names first, so that a family name inside a whole name does not come before it
    mentions = F.array_sort("__mentions", lambda a, b: F.when(F.length(a["raw"]) != F.length(b["raw"]), F.length(b["raw"]) - F.length(a["raw"])).when(a["raw"] < b["raw"], -1).when(a["raw"] > b["raw"], 1).otherwise(0))
    pattern = F.when(F.size("__mentions") > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(mentions, lambda x: F.concat(F.lit(r"\Q"), x["raw"], F.lit(r"\E"))), "|"), F.lit(r")(?![\p{L}\p{N}])")))

    def mentioned(piece: Column) -> Column:
        """A stretch between matches with the mentions in it replaced, and their number."""
        again = F.regexp_extract_all(piece, F.col("__pattern"), F.lit(0))
        swapped = F.transform(again, lambda m: F.element_at(F.map_from_entries(F.col("__mentions")), m))
        rest_of = F.split(piece, F.col("__pattern"), -1)
        woven = let(rest_of, lambda between: F.concat(F.array_join(F.transform(swapped, lambda x, i: F.concat(F.get(between, i), x)), ""), F.element_at(between, -1)))
        plain = F.struct(piece.alias("t"), F.lit(0).alias("n"))
        return F.when(F.col("__pattern").isNull() | ~F.regexp_like(piece, F.col("__pattern")), plain).otherwise(F.struct(woven.alias("t"), F.size(again).alias("n")))

    def spliced(between: Column) -> Column:
        swapped = F.transform(F.col("__found"), lambda m, i: F.concat(F.get(between, i)["t"], F.element_at(F.col("__map"), m)))
        n = F.aggregate(between, F.size("__found"), lambda a, x: a + x["n"])
        return F.struct(F.concat(F.array_join(swapped, ""), F.element_at(between, -1)["t"]).alias("t"), n.alias("n"))

    done = let(F.transform(F.split(text, ANY, -1), mentioned), spliced)
    replaced = joined.withColumn("__pattern", pattern).withColumn("__new", F.when(F.col("__found").isNotNull(), done))
    replaced = replaced.withColumn(text_col, F.coalesce(F.col("__new.t"), text)).withColumn("n_entities", F.coalesce(F.col("__new.n"), F.lit(0)).cast("long"))
    return clean.select(*columns, "n_entities").unionByName(replaced.select(*columns, "n_entities"))
