"""PII surrogates: detected entities get keyed replacements of their own type, gender, script and format.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewmetrics.llm.scratch import written

EMAIL = r"(?<![A-Za-z0-9._+\-])[A-Za-z0-9._+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9\-])"
_QUOTE = r"(?:\\?[\"'`])?"
#: the end of a secret's name, so that words before it may belong to the name, and what leads to the value
SECRET_NAME = r"(?=[tspaTSPA])(?i:token|secret(?:[_\-]?key)?|passw(?:or)?d|api[_\-]?key|access[_\-]?key)" + _QUOTE + r"\s*+[=:]{1,2}>?\s*+"
SECRET_HEAD, SECRET_TAIL = "^" + SECRET_NAME + _QUOTE, r"\\?[\"'`]$"
#: up to the closing quote of its line, else up to a blank or quote without the punctuation before it
SECRET = SECRET_NAME + r"(?:\\?\"[^\"\r\n]{12,}\"|\\?'[^'\r\n]{12,}'|\\?`[^`\r\n]{12,}`|" + _QUOTE + r"[^\s\"'`]{12,}(?<![.,;:!?)\]}\\]))"
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Κυρία"),
    "n": ("Dr", "Prof"),
}
_NAME = r"\p{Lu}[\p{L}'’\-]+"
PERSON_TITLE = r"(?<![\p{L}\p{N}])(?:" + "|".join(t for held in TITLES.values() for t in sorted(held, key=len, reverse=True)) + r")\.?\s"
#: words within a name that need no capital, and initials; blanks of one line or one line break between words
_BLANK = r"(?:[^\S\r\n]++|\r?\n)"
_PARTICLES = "van von vom zu zur der den dem des de del della delle di da das do dos du la las le les los el al af av ten ter te bin bint ibn ben y e i und".split()
_INNER = rf"(?:(?:{'|'.join(sorted(_PARTICLES, key=len, reverse=True))}|d['’]|\p{{Lu}}\.){_BLANK})*+"
#: possessive, as a loop then needs no stack however long a name is
PERSON = PERSON_TITLE + rf"{_INNER}{_NAME}(?:{_BLANK}{_INNER}{_NAME})*+"
PHONE = r"(?<![\w+])(?:\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}|\+\d{1,3}(?:[ .\-]?\(?\d{2,4}\)?){2,5}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
#: in the order in which they are tried at a place
PATTERNS = {"email": EMAIL, "secret": SECRET, "person": PERSON, "phone": PHONE, "ssn": SSN, "card": CARD, "ip": IP}
ANY = "|".join(PATTERNS.values())

#: after so many collisions a surrogate may leave its format for more room, after so many there is an error
LOOSEN, GIVE_UP = 8, 64

SYLLABLES = {
    "latin": "ba be bo da de do fa fe fi ga go ha he hi ja jo ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta".split(),
    "cyrillic": "ба бе бо ва ве ви га го да де до за зо ка ки ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се со та те ти то".split(),
    "greek": "βα βε βο γα γο δα δε δο ζα ζω θα θε κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σο τα τε τι".split(),
}
GIVEN_END = {("latin", "f"): "a", ("latin", "m"): "n", ("latin", "n"): "el", ("cyrillic", "f"): "на", ("cyrillic", "m"): "н", ("cyrillic", "n"): "ль",
             ("greek", "f"): "να", ("greek", "m"): "νος", ("greek", "n"): "λι"}
SURNAME_END = {("latin", "f"): "ler", ("latin", "m"): "ler", ("latin", "n"): "ler", ("cyrillic", "f"): "ва", ("cyrillic", "m"): "в", ("cyrillic", "n"): "ко",
               ("greek", "f"): "δου", ("greek", "m"): "δης", ("greek", "n"): "κη"}


def _keyed(secret: str, *parts) -> Column:
    """128 bytes in hex that only the key's holder can tell from the parts."""
    message = F.concat_ws("\x1f", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    inner = F.sha2(F.concat(F.lit(secret + "\x1e"), message), 256)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{secret}\x1d{i}"), inner), 256) for i in range(4)])


def _byte(hashed: Column, i: Column) -> Column:
    return F.conv(F.substr(hashed, F.pmod(i, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _held(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` reads it for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chars(text: Column, hashed: Column, keep: Column | int = 0) -> Column:
    """``text`` with other digits for digits and other letters of the same case for ASCII letters, after ``keep`` characters."""
    keep = keep if isinstance(keep, Column) else F.lit(keep)

    def other(c: Column, i: Column, held: Column) -> Column:
        byte = _byte(held, i)
        letter = F.char((byte % 26 + 97).cast("int"))
        return (
            F.when(i < keep, c).when(c.rlike("[0-9]"), (byte % 10).cast("string")).when(c.rlike("[a-z]"), letter)
            .when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)
        )

    return _held(hashed, lambda held: F.array_join(F.transform(F.split(text, ""), lambda c, i: other(c, i, held)), ""))


def kind_of(raw: Column) -> Column:
    """The type of what ``ANY`` has found; null for numbers that only look like a card or a phone."""
    whole = None
    for name, pattern in PATTERNS.items():
        hit = raw.rlike(f"^(?:{pattern})$")
        if name == "card":
            hit = hit & F.call_function("luhn_check", F.regexp_replace(raw, r"\D", ""))
        if name == "phone":
            hit = hit & F.length(F.regexp_replace(raw, r"\D", "")).between(7, 15)
        whole = F.when(hit, name) if whole is None else whole.when(hit, name)
    return whole


def _gender(raw: Column) -> Column:
    title = F.regexp_extract(raw, r"^([\p{L}\-]+)", 1)
    return F.when(title.isin(*TITLES["f"]), "f").when(title.isin(*TITLES["m"]), "m").otherwise("n")


def canonical(kind: Column, raw: Column) -> Column:
    """What all spellings of one entity have in common."""
    names = F.regexp_replace(F.regexp_replace(raw, "^" + PERSON_TITLE, ""), r"\s+", " ")
    script = F.when(names.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(names.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    return (
        F.when(kind == "email", F.lower(raw)).when(kind == "secret", F.regexp_replace(F.regexp_replace(raw, SECRET_HEAD, ""), SECRET_TAIL, ""))
        .when(kind == "person", F.concat_ws("|", _gender(raw), script, F.lower(names))).when(kind == "phone", F.regexp_replace(raw, r"[^\d+]", ""))
        .when(kind.isin("card", "ssn"), F.regexp_replace(raw, r"\D", "")).otherwise(raw)
    )


def _email(canon: Column, secret: str, attempt: Column) -> Column:
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    site = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    hashed = _keyed(secret, "email", canon, attempt)
    more = F.when(attempt >= LOOSEN, F.substr(_chars(F.repeat(F.lit("a"), 12), F.reverse(hashed)), F.lit(1), attempt - LOOSEN + 1)).otherwise("")
    return F.concat(_chars(local, hashed), more, F.lit("@"), _chars(site, _keyed(secret, "domain", domain)), top)


def _phone(canon: Column, secret: str, attempt: Column) -> Column:
    keep = F.when(canon.rlike(r"^\+[17]"), 2).when(canon.startswith("+"), 3).otherwise(0)
    other = _chars(canon, _keyed(secret, "phone", canon, attempt), keep)
    first = F.substr(other, keep + 1, F.lit(1)).cast("int")
    return F.concat(F.substr(other, F.lit(1), keep), (first % 8 + 2).cast("string"), F.substr(other, keep + 2))


def _card(canon: Column, secret: str, attempt: Column) -> Column:
    other = F.substr(_chars(canon, _keyed(secret, "card", canon, attempt), 1), F.lit(1), F.length(canon) - 1)
    ends = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(other, d.cast("string"))))
    return F.concat(other, F.get(ends, F.lit(0)).cast("string"))


def _ip(canon: Column, secret: str, attempt: Column) -> Column:
    hashed = _keyed(secret, "ip", canon, attempt)
    inside = canon.rlike(r"^(?:10|127)\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^169\.254\.")
    keep = F.when(canon.rlike(r"^(?:10|127)\."), 1).when(inside, 2).otherwise(0)

    def octet(o: Column, i: Column) -> Column:
        n = _byte(hashed, i * 2) * 256 + _byte(hashed, i * 2 + 1)
        wide = F.when(attempt >= LOOSEN, 3).otherwise(F.length(o))
        return F.when(i < keep, o).when(wide == 1, (n % 9 + 1).cast("string")).when(wide == 2, (n % 90 + 10).cast("string")).otherwise((n % 123 + 101).cast("string"))

    return F.array_join(F.transform(F.split(canon, r"\."), octet), ".")


def _names(canon: Column, secret: str, attempt: Column) -> Column:
    parts = F.split(canon, r"\|")
    told = F.struct(parts[0].alias("gender"), parts[1].alias("script"), F.split(parts[2], " ").alias("words"))
    tables = F.create_map(*[x for s, held in SYLLABLES.items() for x in (F.lit(s), F.array(*map(F.lit, held)))])
    ends = [F.create_map(*[x for (s, g), end in held.items() for x in (F.lit(s + g), F.lit(end))]) for held in (GIVEN_END, SURNAME_END)]

    def name(word: Column, i: Column, told: Column) -> Column:
        gender, script, words = told["gender"], told["script"], told["words"]
        last = i == F.size(words) - 1
        hashed = _keyed(secret, "name", F.when(last, "s").otherwise(F.concat(F.lit("g"), gender)), script, word, attempt)
        held = F.element_at(tables, script)
        some = F.transform(F.sequence(F.lit(0), F.when(attempt >= LOOSEN, 3).otherwise(2)), lambda k: F.get(held, _byte(hashed, k) % F.size(held)))
        end = F.when(last, F.element_at(ends[1], F.concat(script, gender))).otherwise(F.element_at(ends[0], F.concat(script, gender)))
        return F.initcap(F.concat(F.array_join(some, ""), end))

    return _held(told, lambda t: F.array_join(F.transform(t["words"], lambda word, i: name(word, i, t)), " "))


def surrogate(kind: Column, canon: Column, secret: str, attempt: Column) -> Column:
    """The replacement of an entity, in canonical form."""
    ssn = _chars(canon, _keyed(secret, "ssn", canon, attempt))
    ssn = F.concat((F.substr(ssn, F.lit(1), F.lit(1)).cast("int") % 8 + 1).cast("string"), F.substr(ssn, F.lit(2)))
    return (
        F.when(kind == "email", _email(canon, secret, attempt)).when(kind == "phone", _phone(canon, secret, attempt)).when(kind == "card", _card(canon, secret, attempt))
        .when(kind == "ip", _ip(canon, secret, attempt)).when(kind == "ssn", ssn).when(kind == "person", _names(canon, secret, attempt))
        .otherwise(_chars(canon, _keyed(secret, "secret", canon, attempt)))
    )


def _as_written(kind: Column, raw: Column, made: Column) -> Column:
    """A canonical surrogate in the spelling of the text: its digits in the places of digits, its case, its prefix or title."""
    digits = F.regexp_replace(made, r"\D", "")
    before = lambda i: F.length(F.regexp_replace(F.substr(raw, F.lit(1), i), r"\D", ""))
    numbered = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, before(i) + 1, F.lit(1))).otherwise(c)), "")
    cased = F.when((F.upper(raw) == raw) & (F.lower(raw) != raw), F.upper(made)).otherwise(made)
    title = F.regexp_extract(raw, "^" + PERSON_TITLE, 0)
    named = F.when(F.upper(F.substr(raw, F.length(title) + 1)) == F.substr(raw, F.length(title) + 1), F.upper(made)).otherwise(made)
    return (
        F.when(kind.isin("phone", "card", "ssn"), numbered).when(kind == "email", cased).when(kind == "secret", F.concat(F.regexp_extract(raw, SECRET_HEAD, 0), made, F.regexp_extract(raw, SECRET_TAIL, 0)))
        .when(kind == "person", F.concat(title, named)).otherwise(made)
    )


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """``kind, canon, made`` for distinct entities ``kind, canon``: no two alike, and none equal to an entity of the input.

    Each round gives the open entities their next keyed surrogate; of those that got the same one the first by
    ``canon`` has it unless an earlier round gave it away, the others go on.  Rounds end when none is open.
    """
    kinds = "kind string, canon string, made string"
    given = entities.sparkSession.createDataFrame([], kinds)
    waiting, attempt = entities.select("kind", "canon"), 0
    real = entities.select("kind", F.when(F.col("kind") == "person", F.substring_index("canon", "|", -1)).otherwise(F.col("canon")).alias("made"))
    while True:
        tried = written(waiting.withColumn("made", surrogate(F.col("kind"), F.col("canon"), secret, F.lit(attempt))))
        if tried.isEmpty():
            return given
        compared = tried.withColumn("shown", F.when(F.col("kind") == "person", F.lower("made")).otherwise(F.col("made")))
        first = compared.groupBy("kind", "shown").agg(F.min(F.struct("canon", "made")).alias("it"))
        free = first.join(real.select("kind", F.col("made").alias("shown")), ["kind", "shown"], "left_anti")
        free = free.select("kind", F.col("it.canon").alias("canon"), F.col("it.made").alias("made"))
        if attempt:
            free = free.join(given, ["kind", "made"], "left_anti").select("kind", "canon", "made")
        free = written(free)
        given = given.unionByName(free) if attempt else free
        waiting, attempt = tried.join(free, ["kind", "canon"], "left_anti").select("kind", "canon"), attempt + 1
        if attempt > GIVE_UP:
            raise ValueError("an entity type has more entities than surrogates")


def replace_entities(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with surrogates for the entities in ``text``, and ``n_entities`` (long) behind them.

    The same entity gets the same surrogate in every text and spelling, different ones different surrogates; both
    depend on ``secret`` alone and on which entities there are.  Types are those of ``PATTERNS``; cards need a
    right check digit, names a title, secrets their name before them (prefixes and quotes may be around it).  Secrets and names have no
    upper length; a secret without quotes ends at a blank.  A name without its title stays.  Texts without entities stay as they are, null
    stays null; rows, repeated ones too, keep their number.  Column names do not matter (``n_entities`` is replaced).

    Texts are read once to find entities and once for the rows without any; an entity that a third of the rows share is one
    row of the table of distinct ones.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(columns)
    found = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    some = F.coalesce(F.col(text).rlike(ANY), F.lit(False))
    row = F.struct(*columns).alias("row")
    hits = written(docs.where(some).select(row, F.col(text).alias("text"), found.alias("found")).withColumn("number", F.monotonically_increasing_id()))
    each = hits.select("number", F.posexplode("found").alias("place", "raw")).withColumn("kind", kind_of(F.col("raw")))
    told = each.withColumn("canon", canonical(F.col("kind"), F.col("raw")))
    made = surrogates(told.where("kind is not null").select("kind", "canon").distinct(), secret)
    shown = F.when(F.col("made").isNull(), F.col("raw")).otherwise(_as_written(F.col("kind"), F.col("raw"), F.col("made")))
    filled = told.join(made, ["kind", "canon"], "left").select("number", F.struct("place", shown.alias("shown"), F.col("made").isNotNull().alias("done")).alias("it"))
    by_row = filled.groupBy("number").agg(F.array_sort(F.collect_list("it")).alias("its"))
    parts = F.split("text", ANY, -1)
    between = F.concat(F.transform("its", lambda x: x["shown"]), F.array(F.lit("")))
    joined = F.array_join(F.flatten(F.zip_with(parts, between, lambda p, x: F.array(p, x))), "")
    replaced = hits.join(by_row, "number").select("row", joined.alias("new"), F.size(F.filter("its", lambda x: x["done"])).cast("long").alias("n_entities"))
    changed = replaced.select(*[F.col("new").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns], "n_entities")
    return changed.unionByName(docs.where(~some).withColumn("n_entities", F.lit(0).cast("long")))
