"""Surrogates for personal data, with DataFrame functions only.

Detected: e-mail addresses; IPv4 and IPv6 addresses; telephone numbers in national and international forms; social security numbers;
passport numbers after a word for a passport; card numbers whose Luhn digit and account numbers (IBAN) whose check digits are right;
and names. A name is a title or a salutation with the capitalised words that follow it, or a given name of the lists below with an
initial and a surname, where they follow, or the capitalised words after a cue ("my name is", "contact", ...), also two such names
joined by "or" or "and".

What is replaced is an entity, wherever and in whatever format it comes (coreference): numbers go by their digits, addresses by
their lower-case form, and each word of a name by itself, so that all who share a surname still do. Surrogates are made from a
key that the caller gives, by HMAC-SHA-256. Digits become digits and hexadecimal ones hexadecimal, spaces and marks stay as they are, check digits are right again,
telephone numbers keep their country and account numbers theirs; mail addresses end in a reserved domain; octets stay octets.
Given names are exchanged within their list, that is gender and script, by a permutation that the key chooses and that leaves no name
in its place, and initials likewise; surnames become names of syllables in the same script, Cyrillic ones with the same gender's ending. Surrogates that
two entities share, or that are themselves entities of the texts, are made again with the next counter until all differ, so
distinct entities stay distinct; names then have one more syllable, so there are always enough.

Only texts with entities shuffle. An entity that very many texts hold is one row of the table of entities, joined by a join
that Spark can split.

A null text stays null and has no entities; empty texts too. Rows with equal or null doc_id are treated each. Without entities
texts come back as they are; no rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import Scratch

#: Given names by gender and script.
NAMES = {
    "female_latin": (
        "Alice Amanda Andrea Anna Anneliese Barbara Beatriz Brigitte Camille Carmen Caroline Catherine Charlotte Christine Claire Claudia Deborah Elena Elizabeth Emily Emma Françoise Gabriela Hannah "
        "Helen Ingrid Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Linda Lucia Margaret María Marie Martina Mary Michelle Monika Nancy Olivia Patricia Rebecca Sabine Sarah Sophie Susan Victoria"
    ).split(),
    "male_latin": (
        "Alejandro Andreas Andrew Antoine Benjamin Carlos Charles Christopher Daniel David Edward Fernando Francisco Frederick George Hans Henry James Jan Javier John Jonathan José Joseph Jürgen Kevin Klaus "
        "Luis Matthew Michael Miguel Nicholas Oliver Paul Pedro Peter Philippe Pierre Richard Robert Ronald Samuel Stefan Steven Thomas Timothy Walter William Wolfgang"
    ).split(),
    "female_cyrillic": "Анастасия Валентина Екатерина Елена Ирина Людмила Мария Наталья Ольга Светлана Татьяна".split(),
    "male_cyrillic": "Александр Алексей Андрей Владимир Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
}
#: What goes before a name; stays as it is.
BEFORE = "Mr Mrs Ms Miss Dr Prof Professor Herr Frau Señor Señora Monsieur Madame Mme Sr Sra Dear Liebe Lieber Cher Chère Estimado Estimada".split()
#: Words after these that are no names.
NOT_NAMES = "Sir Madam All Team Friends Friend Customer Customers Us Me Information Info Details Support Sales Service Reader Readers Colleagues Colleague Everyone Editor Student Students God Lord Diary And The Of To In".split()
#: What goes before a name, and how many capitalised words it takes there.
CUES = {
    1: "[Mm]y name is|[Mm]y name's|[Mm]ein Name ist|[Ii]ch heiße|[Jj]e m'appelle|[Mm]on nom est|[Mm]e llamo|[Mm]i nombre es|[Nn]ame:|[Aa]ttn[.:]|[Ss]igned by",
    2: "[Cc]ontact|[Kk]ontakt|[Cc]ontacto",
}
JOINED = "and or und oder et ou y o".split()
_PASSPORT = r"(?:[Pp]assport|PASSPORT|[Rr]eisepass|[Pp]asseport|[Pp]asaporte)(?: (?:[Nn]o|[Nn]umber|[Nn]r|[Nn]ummer|[Nn]úmero|[Nn]uméro)\.?)?:? ?"
_WORD = r"\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+)*+(?!\p{L})"


def _by_letter(words: list[str]) -> str:
    """An alternation in which each first letter is tried once."""
    letters = sorted({w[0] for w in words})
    return "|".join(f"{c}(?:{'|'.join(sorted((w[1:] for w in words if w[0] == c), key=len, reverse=True))})" for c in letters)


_GIVEN = _by_letter([n for v in NAMES.values() for n in v])
_CAPITAL = r"(?<!\p{L})(?=\p{Lu})"
#: Kind, its whole form; looked for in this order at each place. Lengths are those that the formats allow, which also keeps the
#: search linear in texts without spaces.
KINDS = (
    ("email", r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@[\p{L}\p{N}](?:[\p{L}\p{N}.-]{0,250}[\p{L}\p{N}])?\.\p{L}{2,}"),
    ("ipv6", r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]{0,45}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("passport", rf"(?<!\p{{L}}){_PASSPORT}[A-Z]{{0,2}}\d{{6,9}}(?![\p{{L}}\p{{N}}])"),
    ("phone", r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
              r"|(?<![\p{L}\p{N}+.,:/-])(?=\+?(?:[ ()/.-]{0,2}\d){9,15}(?![ ./-]?\d))(?:\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d{1,5}(?:[ .-]\d{2,5}){1,4}|0\d{2,5}[ /-]\d{3,4}[ -]?\d{2,5})(?![\p{L}\p{N}]|[.,:/-]\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)"),
    ("cued", rf"(?<!\p{{L}})(?=[\p{{L}}])(?:(?:{CUES[1]}) (?!(?:{'|'.join(NOT_NAMES)})(?!\p{{L}})){_WORD}(?: \p{{Lu}}\.)?(?: {_WORD}){{0,2}}|(?:{CUES[2]}) (?!(?:{'|'.join(NOT_NAMES)})(?!\p{{L}})){_WORD}(?: \p{{Lu}}\.)? {_WORD}(?: {_WORD})?)(?: (?:{'|'.join(JOINED)}) {_WORD} {_WORD})?"),
    ("name", rf"{_CAPITAL}(?:(?:{_by_letter(BEFORE)})\.? (?!(?:{'|'.join(NOT_NAMES)})(?!\p{{L}})){_WORD}(?: \p{{Lu}}\.)?(?: {_WORD}){{0,2}}|(?:{_GIVEN})(?!\p{{L}})(?: \p{{Lu}}\.)?(?: {_WORD})?)"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
#: A text without a match of this has no entity; cheaper to look for.
HINT = rf"[@0-9]|::|{CUES[1]}|{CUES[2]}|{_CAPITAL}(?:{_by_letter([*BEFORE, *(n for v in NAMES.values() for n in v)])})(?!\p{{L}})"
#: Alphabets in which letters are exchanged.
_LOWER = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_SORTS = ("0123456789", *(x for low in _LOWER.values() for x in (low, low.upper())))
_HEX = ("0123456789", "abcdef", "ABCDEF")
#: Syllables of surnames are any of the first letters with any of the second.
_SYLLABLES = {"latin": ("bdfghklmnprstvw", "aeiou", ("n", "r", "s", "ll")), "cyrillic": ("бвгдзклмнпрст", "аеиоу", ("в",)), "greek": ("βγδκλμνπρστφ", "αειου", ("ς",))}


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, p in reversed(KINDS):
        own = entity.rlike(f"^(?:{p})$")
        own = own & luhn(_digits(entity)) if k == "card" else own & (_mod97(_compact(entity)) == 1) if k == "iban" else own
        out = F.when(own, F.lit(k)).otherwise(out)
    return out


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _compact(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn_sum(digits: Column) -> Column:
    """Every second digit from the last but one on counts double."""
    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(F.reverse(_characters(digits)), one), F.lit(0), lambda a, b: a + b)


def luhn(digits: Column) -> Column:
    return _luhn_sum(digits) % 10 == 0


def _mod97(iban: Column) -> Column:
    """Of an account number without spaces: country and check digits go last, letters count as 10 to 35."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    value = lambda r, c: F.when(c.rlike("[0-9]"), r * 10 + c.cast("int")).otherwise(r * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(_characters(turned), F.lit(0), lambda r, c: value(r, c).cast("int"))


def _byte(digest: Column, i: Column) -> Column:
    """Byte i of a hexadecimal digest, again from the start after its end."""
    return F.conv(F.substr(digest, (i % 31) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _exchanged(text: Column, digest: Column, sorts: tuple[str, ...] = _SORTS) -> Column:
    """Each digit and letter by one of its sort, other letters by Latin ones."""
    every = "".join(sorts)
    starts = F.array(*[F.lit(every.index(x) + 1) for x in sorts for _ in x])
    sizes = F.array(*[F.lit(len(x)) for x in sorts for _ in x])

    def one(c: Column, i: Column) -> Column:
        at, b = F.instr(F.lit(every), c), _byte(digest, i)
        other = F.substr(F.lit(_LOWER["latin"]), b % 26 + 1, F.lit(1))
        foreign = F.when(c == F.lower(c), other).otherwise(F.upper(other))
        same = F.substr(F.lit(every), F.get(starts, at - 1) + b % F.get(sizes, at - 1), F.lit(1))
        return F.when(at > 0, same).when(c.rlike(r"\p{L}"), foreign).otherwise(c)

    return F.array_join(F.transform(_characters(text), one), "")


def _surname(word: Column, digest: Column, attempt: Column) -> Column:
    """Syllables, one more with each attempt, in the script of the word."""
    def of(script: str) -> Column:
        first, second, ends = _SYLLABLES[script]
        part = lambda i: F.concat(F.substr(F.lit(first), _byte(digest, i * 2) % len(first) + 1, F.lit(1)), F.substr(F.lit(second), _byte(digest, i * 2 + 1) % len(second) + 1, F.lit(1)))
        made = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), part), "")
        end = F.get(F.array(*map(F.lit, ends)), _byte(digest, F.lit(30)) % len(ends))
        return F.concat(F.upper(F.substr(made, F.lit(1), F.lit(1))), F.substr(made, F.lit(2)), end)

    cyrillic = F.concat(of("cyrillic"), F.when(word.rlike("[ая]$"), F.lit("а")).otherwise(F.lit("")))
    return F.when(word.rlike(r"\p{IsCyrillic}"), cyrillic).when(word.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def _exchanges(key: str) -> tuple[list[str], list[str]]:
    """Given names and initials, and what they become: in the order of their codes each the next one, so a list of n has (n - 1)!
    permutations, and some known pairs don't give the others."""
    lists = {**NAMES, **{f"initial_{k}": [f"{c}." for c in low.upper()] for k, low in _LOWER.items()}}
    said, made = [], []
    for k, own in lists.items():
        order = sorted(own, key=lambda name: hmac.digest(key.encode(), f"{k}\x01{name}".encode(), "sha256"))
        said += order
        made += order[1:] + order[:1]
    return said, made


def _coded(key: str, message: Column) -> Column:
    """HMAC-SHA-256 in hexadecimal."""
    own = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    inner, outer = (F.lit(bytearray(b ^ pad for b in own.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def surrogate(known: DataFrame, key: str) -> DataFrame:
    """known (kind, entity, attempt) with the surrogate of that attempt."""
    entity, kind, digest, core = (F.col(c) for c in ("entity", "kind", "digest", "core"))
    out = known.withColumn("digest", _coded(key, F.concat_ws("\x01", kind, entity, F.col("attempt").cast("string"))))
    # what is exchanged character by character
    part = F.when(kind == "email", F.substring_index(entity, "@", 1)).when(kind == "iban", F.substr(entity, F.lit(5))).when(kind.isin("phone", "ssn", "card", "passport"), entity).otherwise(F.lit(""))
    out = out.withColumn("core", F.when(kind == "ipv6", _exchanged(entity, digest, _HEX)).otherwise(_exchanged(part, digest)))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(digest, i) % 254 + 1).cast("string")), ".")
    most = F.substr(core, F.lit(1), F.length(core) - 1)
    check = F.lpad((98 - _mod97(F.concat(F.substr(entity, F.lit(1), F.lit(2)), F.lit("00"), core))).cast("string"), 2, "0")
    said, given = _exchanges(key)
    made = F.when(kind == "email", F.concat(core, F.lit("@m"), F.substr(digest, F.lit(50), F.lit(8)), F.lit(".example.net"))).when(kind == "ip", octets)
    made = made.when(kind == "card", F.concat(most, ((10 - _luhn_sum(F.concat(most, F.lit("0"))) % 10) % 10).cast("string")))
    made = made.when(kind == "iban", F.concat(F.substr(entity, F.lit(1), F.lit(2)), check, core))
    made = made.when(kind == "given", F.get(F.array(*map(F.lit, given)), F.array_position(F.array(*map(F.lit, said)), entity).cast("int") - 1))
    made = made.when(kind == "surname", _surname(entity, digest, F.col("attempt"))).otherwise(core)
    return out.select("kind", "entity", "attempt", made.alias("surrogate"))


def surrogates(entities: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """kind, entity, surrogate of distinct (kind, entity). Given names differ by their permutation; all other surrogates are made to
    differ from each other's of their kind and from all entities."""
    known = scratch.put(entities.withColumn("attempt", F.lit(0)), "entities")
    while True:
        made = scratch.put(surrogate(known, key), "made")
        free = made.where("kind != 'given'")
        first = free.groupBy("kind", "surrogate").agg(F.min("entity").alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "surrogate", "first")
        shared = free.join(first, ["kind", "surrogate"]).where("entity != first").select("kind", "entity")
        itself = free.join(made.select("kind", F.col("entity").alias("surrogate")).distinct(), ["kind", "surrogate"], "left_semi").select("kind", "entity")
        clash = scratch.put(shared.union(itself).distinct(), "clash")
        if clash.isEmpty():
            return made.select("kind", "entity", "surrogate")
        known = made.join(clash.withColumn("again", F.lit(1)), ["kind", "entity"], "left").select("kind", "entity", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))


def _pieces(said: Column, kind: Column) -> Column:
    """Entities of a match: (kind, entity, said) of each word of a name, or of the whole."""
    given = F.lit([n for v in NAMES.values() for n in v])
    word = lambda w: F.when(F.array_contains(given, w) | w.rlike(r"^\p{Lu}\.$"), F.lit("given")).otherwise(F.lit("surname"))
    title = lambda w: F.regexp_replace(w, r"\.$", "").isin(BEFORE)
    none = F.lit(None).cast("string")
    no_name = lambda w, i: (w == "") | w.isin(JOINED) | ((i == 0) & title(w))
    words = lambda t: F.transform(F.split(t, " "), lambda w, i: F.struct(F.when(no_name(w, i), none).otherwise(word(w)).alias("kind"), w.alias("entity"), F.when(i == 0, w).otherwise(F.concat(F.lit(" "), w)).alias("said")))
    alone = lambda t: F.array(F.struct(none.alias("kind"), t.alias("entity"), t.alias("said")))
    cue, before = F.regexp_extract(said, f"^(?:{CUES[1]}|{CUES[2]})", 0), F.regexp_extract(said, f"^{_PASSPORT}", 0)
    number = F.substr(said, F.length(before) + 1)
    of_passport = F.concat(alone(before), F.array(F.struct(F.lit("passport").alias("kind"), number.alias("entity"), number.alias("said"))))
    entity = F.when(kind == "email", F.lower(said)).when(kind == "iban", _compact(said)).when(kind.isin("ssn", "card"), _digits(said)).when(kind == "phone", F.substr(F.regexp_replace(_digits(said), "^0", ""), F.lit(-10))).when(kind == "ipv6", F.lower(said)).otherwise(said)
    whole = F.when(kind == "name", words(said)).when(kind == "cued", F.concat(alone(cue), words(F.substr(said, F.length(cue) + 1)))).when(kind == "passport", of_passport)
    return whole.otherwise(F.array(F.struct(kind.alias("kind"), entity.alias("entity"), said.alias("said"))))


def _refilled(said: Column, made: Column) -> Column:
    """The digits, or letters and digits, of `made` in the format of `said`; what `said` has more stands before them."""
    own = F.regexp_replace(said, "[^A-Z0-9]", "")
    ahead = F.length(own) - F.length(made)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        counts = c.rlike("[A-Z0-9]")
        new = F.when(~counts | (acc["at"] < ahead), c).otherwise(F.substr(made, acc["at"] - ahead + 1, F.lit(1)))
        return F.struct((acc["at"] + counts.cast("int")).alias("at"), F.concat(acc["out"], new).alias("out"))

    return F.aggregate(_characters(said), start, step, lambda acc: acc["out"])


def _row() -> Column:
    """What rows are joined back by: 128 bits of doc_id and text, as with 64 two of 10^10 documents could swap what is found in them."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\x00"), F.col("text"))))


def replace(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_entities, text with surrogates. key: a secret of the caller's; the same key gives the same surrogates."""
    if not key:
        raise ValueError("surrogates need a key")
    scratch = Scratch(docs.sparkSession)
    base = docs.select("doc_id", "text")
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))
    some = scratch.put(base.withColumn("found", found).where(F.size("found") > 0).withColumn("row", _row()), "found")
    each = some.select("row", F.posexplode("found").alias("at", "match")).distinct().withColumn("whole", kind_of(F.col("match")))
    each = each.select("row", "at", "whole", F.posexplode(_pieces(F.col("match"), F.col("whole"))).alias("sub", "x")).select("row", "at", "whole", "sub", "x.*")
    each = scratch.put(each, "pieces")
    table = surrogates(each.where("kind is not null").select("kind", "entity").distinct(), scratch, key)
    named = each.join(table, ["kind", "entity"], "left")
    made = F.when(F.col("kind").isin("phone", "ssn", "card", "iban"), _refilled(F.col("said"), F.col("surrogate"))).when(F.col("whole").isin("name", "cued"), F.concat(F.when(F.col("sub") > 0, F.lit(" ")).otherwise(F.lit("")), F.col("surrogate")))
    made = made.when(F.col("kind").isin("email", "ipv6") & (F.col("said") == F.upper("said")) & F.col("said").rlike("[A-Z]"), F.upper("surrogate")).otherwise(F.col("surrogate"))
    value = F.when(F.col("surrogate").isNull(), F.col("said")).otherwise(made)
    whole = F.count_if((F.col("sub") == 0) & F.col("whole").isNotNull())
    own = named.groupBy("row").agg(F.collect_list(F.struct("at", (F.col("sub") + 1).alias("sub"), value.alias("value"))).alias("values"), whole.alias("n_entities"))
    cuts = F.transform(F.split("text", PATTERN, -1), lambda c, i: F.struct(i.alias("at"), F.lit(0).alias("sub"), c.alias("value")))
    joined = some.join(own, "row")
    text = F.array_join(F.transform(F.array_sort(F.concat(cuts, "values")), lambda x: x["value"]), "")
    changed = joined.select("doc_id", "n_entities", text.alias("text"))
    plain = base.where(F.coalesce(F.size(found), F.lit(0)) <= 0).select("doc_id", F.lit(0).cast("long").alias("n_entities"), "text")
    return plain.unionByName(changed)
