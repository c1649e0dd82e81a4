"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent.

Detection finds e-mail addresses, phone numbers (E.164, national groups), payment
cards (Luhn), IPv4 and IPv6 addresses, IBANs (mod 97), US social security numbers,
and names after a title. A person named with a title is found again without it in
the same text: the full name in any case, the surname where it is capitalised.

An entity is (kind, normal form). A surname is an entity, and a full name one more
that holds its surname, so "Dr Anna Schmidt", "Mrs. Schmidt" and "Anna Schmidt"
get one surname between them, in all texts alike. Gender belongs to the full name
and is settled over the corpus: by its titles, else by its given name; titles of
both genders make it neutral. Each distinct entity of the corpus gets one surrogate:

- keyed: drawn from BLAKE2b(key, kind, normal form, attempt). The key comes from the
  caller or from ``spark.tracewright.pii.key``; the constant is for tests;
- type consistent: same format (digit groups, case, length of local part and
  domain labels, top-level domain, country, card issuer digit), valid check
  digits, same address class; names keep gender, script, title and number of words;
- distinct: attempts go on until no two entities of a family (all e-mails, all
  surnames, all full names whatever their gender) share a surrogate and none equals
  a real entity of the corpus. Ties go to the smallest normal form, so the outcome
  does not depend on the order of rows. Later attempts draw from larger sets, so
  few rounds do for any number of entities.

Not found: names that no title in their text introduces, names in scripts other
than Latin and Cyrillic, and postal addresses.

Scale. Only texts in which something like an entity occurs (a native pattern)
go to Python and into a shuffle; the others pass straight through. Mentions are
made distinct per text before they meet; the table of entities is joined and
counted in Spark and never collected. Copies of a text share one row of the
mapping; the join on the text's fingerprint is one that AQE splits.

Defined cases: a null text stays null with no entity; empty texts stay; an empty
table gives no rows; repeated rows are replaced alike; doc_id plays no part, so it
may be null; all columns of the input are kept, whatever their names, but one named
``n_replaced`` is replaced; a text of any length is read whole, in time that follows
its length; where patterns overlap the first kind of ``PATTERNS`` wins.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

KEY = "tracewright"
# Titles by gender, given names to draw from, and the sounds of surnames.
TITLES = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Г-н": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Г-жа": "f",
    "Dr": "n", "Prof": "n",
}
GIVEN = {
    ("m", "latin"): "Adrian Bruno Conrad Dario Edgar Felix Gustav Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Quentin Robert Simon Tobias".split(),
    ("f", "latin"): "Alice Berta Clara Diana Emma Flora Greta Helena Irene Julia Klara Laura Maria Nora Olivia Paula Rosa Sophie Theresa Vera".split(),
    ("n", "latin"): "Alex Andrea Chris Dominique Jean Kim Luca Robin Sascha Toni".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Павел".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Софья".split(),
    ("n", "cyrillic"): "Женя Саша Валя Шура".split(),
}
#: First sounds, vowels and ends; surnames of two syllables or more by these, none of which declines by gender.
SOUNDS = {
    "latin": ("b br d dr f g gr h k kl l m n p r s st t tr v w".split(), "a e i o u".split(), "ck ld lm nd nn r rn rt s t".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т х".split(), "а е и о у".split(), "енко их ых дзе швили".split()),
}

_TITLE = "|".join(map(re.escape, sorted(TITLES, key=len, reverse=True)))
_WORD = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zà-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zà-öø-ÿа-яё]+)?"
_TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
#: In this order; a later match never overlaps an earlier one.
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)"),
    "ipv6": re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}(?![\w:])"),
    "phone": re.compile(
        r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\w)"
        r"|(?<![\w+])\+\d{1,3}(?:[ .-]\d{1,8}){1,5}(?!\w)|(?<![\w+])\+\d{7,15}(?!\w)"
        r"|(?<![\w+.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w)|(?<![\w+.-])0\d{2,4}[ /-]\d{5,8}(?!\w)"
    ),
    "ssn": re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"),
    "card": re.compile(r"(?<!\w)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\w)"),
    "name": re.compile(rf"(?<!\w)(?P<title>{_TITLE})(?:\. ?| )(?P<name>{_WORD}(?: {_WORD}){{0,2}})"),
}
#: Characters that every match of a pattern has.
NEEDED = {"email": "@.", "ip": ".", "ipv6": ":", "ssn": "-"}
#: Whatever one of PATTERNS finds, this finds too; native and cheap.
GUARD = rf"@[A-Za-z0-9]|[0-9][0-9A-Z .()-]{{5}}|[0-9A-Fa-f]:[0-9A-Fa-f]*:|::[0-9A-Fa-f]|(?<!\w)(?:{_TITLE})[. ]"


def luhn_digit(digits: str) -> str:
    """The check digit that completes digits."""
    total = sum(int(d) if k % 2 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _script(name: str) -> str:
    return "cyrillic" if re.search("[А-Яа-яЁё]", name) else "latin"


def _gender(title: str, name: str) -> str:
    g = TITLES[title]
    first = name.split(" ")[0]
    return next((k[0] for k, v in GIVEN.items() if k[0] != "n" and first in v), "n") if g == "n" else g


def entity(kind: str, m: re.Match) -> tuple[str, str] | None:
    """(kind, normal form) of a match, None if it fails its check."""
    s = m[0]
    if kind == "email":
        return kind, s.lower()
    if kind == "name":
        name = m["name"]
        return f"{'name' if ' ' in name else 'surname'}:{_script(name)}", name.casefold()
    if kind == "iban":
        s = s.replace(" ", "")
        return (kind, s) if 15 <= len(s) <= 34 and iban_digits(s[:2], s[4:]) == s[2:4] else None
    if kind == "ip":
        return kind, s
    if kind == "ipv6":
        try:
            return (kind, ipaddress.IPv6Address(s).compressed) if re.search(r"\d", s) and len(s) > 3 else None
        except ValueError:
            return None
    s = re.sub(r"\D", "", s)
    if kind == "card" and (luhn_digit(s[:-1]) != s[-1] or len(set(s)) == 1):
        return None
    if kind == "phone" and not 7 <= len(s) <= 15:
        return None
    return kind, s


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form), ascending, without overlaps."""
    return [x[:4] for x in gendered_mentions(text)]


def gendered_mentions(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """The mentions with the gender that a title or given name shows."""
    text = text or ""
    out: list[tuple[int, int, str, str, str]] = []
    genders: dict[str, str] = {}
    surnames: set[str] = set()

    def take(a: int, b: int, kind: str, normal: str, gender: str) -> None:
        k = bisect_left(out, (a,))
        if (k == 0 or out[k - 1][1] <= a) and (k == len(out) or b <= out[k][0]):
            out.insert(k, (a, b, kind, normal, gender))

    for kind, pattern in PATTERNS.items():
        if any(x not in text for x in NEEDED.get(kind, "")):
            continue
        for m in pattern.finditer(text):
            if not (e := entity(kind, m)):
                continue
            if kind == "name":
                gender = _gender(m["title"], m["name"])
                take(*m.span("name"), *e, gender)
                surnames.add(e[1].rsplit(" ", 1)[-1])
                if " " in e[1] and genders.get(e[1], "n") == "n":
                    genders[e[1]] = gender
            else:
                take(*m.span(), *e, "n")
    if surnames:
        tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
        folded = [t[2].casefold() for t in tokens]
        k = 0
        while k < len(tokens):
            n = next((n for n in (3, 2) if k + n <= len(tokens) and " ".join(folded[k : k + n]) in genders and tokens[k + n - 1][1] - tokens[k][0] == sum(map(len, folded[k : k + n])) + n - 1), 0)
            a, _, word = tokens[k]
            if n:
                name = " ".join(folded[k : k + n])
                take(a, tokens[k + n - 1][1], f"name:{_script(name)}", name, genders[name])
            elif folded[k] in surnames and word[0].isupper():
                take(a, tokens[k][1], f"surname:{_script(word)}", folded[k], "n")
            k += n or 1
    return out


def _draw(key: str, *parts: object) -> Callable[[int], int]:
    """A keyed source of small integers below n."""
    state = {"n": 0, "v": 0, "left": 0}

    def below(n: int) -> int:
        if state["left"] < 2:
            seed = "\x1f".join(map(str, (*parts, state["n"]))).encode()
            state["v"], state["left"] = int.from_bytes(hashlib.blake2b(seed, key=key.encode()[:64], digest_size=64).digest()), 12
            state["n"] += 1
        state["left"] -= 1
        state["v"], r = divmod(state["v"], n << 24)
        return r % n

    return below


def _like(s: str, below: Callable[[int], int]) -> str:
    """Letters for letters, digits for digits, the rest as it is."""
    return "".join(str(below(10)) if c.isdigit() else "abcdefghijklmnopqrstuvwxyz"[below(26)] if c.isalpha() else c for c in s)


def _surname(script: str, attempt: int, below: Callable[[int], int]) -> str:
    first, vowels, ends = SOUNDS[script]
    return "".join(first[below(len(first))] + vowels[below(len(vowels))] for _ in range(2 + attempt)) + ends[below(len(ends))]


def surrogate(kind: str, normal: str, attempt: int, key: str, gender: str = "n", surname: str | None = None) -> str:
    """The attempt-th surrogate of an entity, in normal form; that of a full name ends with its surname's surrogate."""
    below = _draw(key, kind, normal, attempt)
    if kind == "email":
        local, domain = normal.split("@")
        labels, top = domain.rsplit(".", 1)
        # a domain's surrogate hangs on the domain alone, so addresses of one domain stay together
        return f"{_like(local, below)}{'' if attempt < 2 else below(10 ** min(attempt, 12))}@{_like(labels, _draw(key, 'domain', labels))}.{top}"
    if kind.startswith("surname:"):
        return _surname(kind.split(":")[1], attempt, below)
    if kind.startswith("name:"):
        given = GIVEN[gender, kind.split(":")[1]]
        # pools are small: later attempts join more given names
        words = ["-".join(given[below(len(given))] for _ in range(1 + attempt // 2)) for _ in range(normal.count(" "))]
        return " ".join([*words, surname or ""]).casefold()
    if kind == "ip":
        first = int(normal.split(".")[0])
        low, high = next((a, b) for a, b in ((0, 126), (127, 127), (128, 191), (192, 223), (224, 255)) if a <= first <= b)
        head = [first] if first in (10, 127) else [low + below(high - low + 1)]
        return ".".join(map(str, head + [below(256) for _ in range(2)] + [1 + below(254)]))
    if kind == "ipv6":
        groups = ipaddress.IPv6Address(normal).exploded.split(":")
        return ipaddress.IPv6Address(":".join([groups[0], *(f"{below(1 << 16):x}" if g != "0000" or k == 6 else "0" for k, g in enumerate(groups[1:]))])).compressed
    if kind == "iban":
        account = "".join(str(below(10)) if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[below(26)] for c in normal[4:])
        return normal[:2] + iban_digits(normal[:2], account) + account
    if kind == "card":
        body = normal[0] + "".join(str(below(10)) for _ in normal[1:-1])
        return body + luhn_digit(body)
    if kind == "ssn":
        return f"{(area := 1 + below(898)) + (area >= 666):03d}{1 + below(99):02d}{1 + below(9999):04d}"
    return "".join(str(2 + below(8)) if k in (max(len(normal) - 10, 0), len(normal) - 7) else c if k < len(normal) - 10 else str(below(10)) for k, c in enumerate(normal))


def _cased(value: str, like: str) -> str:
    """value with the case of like, character by character as far as both go."""
    return "".join(c.upper() if k < len(like) and like[k].isupper() else c for k, c in enumerate(value))


def rendered(mention: str, kind: str, value: str) -> str:
    """value, a surrogate in normal form, in the format of the mention."""
    if kind in ("phone", "card", "ssn", "iban"):
        it = iter(value)
        return "".join(next(it) if c.isalnum() else c for c in mention)
    if kind == "email":
        (local, domain), (own, at) = value.split("@"), mention.split("@")
        return f"{_cased(local, own)}@{_cased(domain, at)}"
    if kind == "ipv6":
        return value.upper() if mention.isupper() else value
    if "name:" in kind:
        if mention.isupper() or mention.islower():
            return value.upper() if mention.isupper() else value
        return re.sub(r"[^\W_]+", lambda m: m[0].capitalize(), value)
    return value


_MENTIONS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "normal", "gender")]))


def _entities_of(text: str | None) -> set[tuple[str, str, str]]:
    """The entities of a text's mentions; a full name brings its surname."""
    out = {x[2:] for x in gendered_mentions(text)}
    return out | {(f"sur{k}", n.rsplit(" ", 1)[-1], "n") for k, n, _ in out if k.startswith("name:")}


@F.pandas_udf(_MENTIONS)
def _found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: [{"kind": k, "normal": n, "gender": g} for k, n, g in sorted(_entities_of(t))])


def _surrogate_udf(key: str):
    @F.pandas_udf("string")
    def draw(kind: pd.Series, normal: pd.Series, gender: pd.Series, surname: pd.Series, attempt: pd.Series) -> pd.Series:
        rows = zip(kind, normal, gender, surname, attempt, strict=True)
        return pd.Series([surrogate(k, n, int(a), key) if s is None else surrogate(k, n, int(a), key, g, s) for k, n, g, s, a in rows], dtype=object)

    return draw


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_replaced", T.LongType())]))
def _replaced(texts: pd.Series, maps: pd.Series) -> pd.DataFrame:
    out, count = [], []
    for text, rows in zip(texts, maps, strict=True):
        n = 0
        if text is not None and rows is not None and len(rows):
            new = {(r["kind"], r["normal"]): r["surrogate"] for r in rows}
            parts, at = [], 0
            for a, b, kind, normal in mentions(text):
                parts += [text[at:a], rendered(text[a:b], kind, new[kind, normal])]
                at, n = b, n + 1
            text = "".join([*parts, text[at:]])
        out.append(text)
        count.append(n)
    return pd.DataFrame({"text": pd.Series(out, dtype=object), "n_replaced": count})


def family(kind: str | Column = "kind") -> Column:
    """The kinds among which surrogates must differ: names of one sort whatever their script."""
    return F.substring_index(kind, ":", 1)


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """entities(kind, normal, and for full names gender and surname), distinct, with a surrogate each that no other
    entity of the family has and that is none. A round draws, keeps the first of equal draws, and tries the rest again."""
    draw = _surrogate_udf(key)
    for c, value in (("gender", "n"), ("surname", None)):
        if c not in entities.columns:
            entities = entities.withColumn(c, F.lit(value).cast("string"))
    columns = ["kind", "normal", "gender", "surname"]
    real = entities.select(family().alias("family"), F.col("normal").alias("surrogate"))
    taken, open_, attempt = None, entities.select(*columns), 0
    while True:
        drawn = written(open_.withColumn("surrogate", draw("kind", "normal", "gender", "surname", F.lit(attempt))).withColumn("family", family()), "drawn", narrow=attempt > 0)
        first = drawn.groupBy("family", "surrogate").agg(F.min(F.struct("normal", "kind")).alias("x"))
        good = first.join(real, ["family", "surrogate"], "left_anti")
        if taken is not None:
            good = good.join(taken.select("family", "surrogate"), ["family", "surrogate"], "left_anti")
        good = written(good.select("family", "x.kind", "x.normal", "surrogate"), "surrogates", narrow=attempt > 0)
        taken = good if taken is None else taken.unionByName(good)
        open_ = written(drawn.join(good.select("kind", "normal"), ["kind", "normal"], "left_anti").select(*columns), "collided", narrow=attempt > 0)
        if open_.isEmpty():
            return taken.select("kind", "normal", "surrogate")
        attempt += 1


def surrogates(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, normal, surrogate) for all entities of found(kind, normal, gender)."""
    shows = lambda g: F.max((F.col("gender") == g).cast("int"))
    every = found.groupBy("kind", "normal").agg(shows("m").alias("m"), shows("f").alias("f"))
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n")
    every = written(every.select("kind", "normal", gender.alias("gender")), "entities", narrow=True)
    plain = assign(every.where("kind not like 'name:%'").select("kind", "normal"), key)
    names = every.where("kind like 'name:%'").withColumn("surname_kind", F.concat(F.lit("sur"), "kind")).withColumn("last", F.substring_index("normal", " ", -1))
    last = plain.select(F.col("kind").alias("surname_kind"), F.col("normal").alias("last"), F.col("surrogate").alias("surname"))
    return plain.unionByName(assign(names.join(last, ["surname_kind", "last"]).select("kind", "normal", "gender", "surname"), key))


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with text replaced and a column n_replaced (the number of mentions)."""
    key = key or docs.sparkSession.conf.get("spark.tracewright.pii.key", KEY)
    may = F.coalesce(F.col("text").rlike(GUARD), F.lit(False))
    rows = docs.select(F.struct("*").alias("_row"), "text")
    plain = rows.where(~may).select("_row", F.struct("text", F.lit(0).cast("long").alias("n_replaced")).alias("_new"))
    marked = rows.where(may).withColumn("_mark", F.xxhash64("text"))
    found = marked.select("_mark", _found("text").alias("m")).select("_mark", F.explode("m").alias("m")).select("_mark", "m.*").distinct()
    found = written(found, "mentions")
    mapping = surrogates(found.select("kind", "normal", "gender"), key)
    pairs = found.select("_mark", "kind", "normal").distinct()
    by_text = pairs.join(mapping, ["kind", "normal"]).groupBy("_mark").agg(F.collect_list(F.struct("kind", "normal", "surrogate")).alias("_map"))
    swapped = marked.join(by_text.hint("merge"), "_mark", "left").select("_row", _replaced("text", "_map").alias("_new"))
    out = plain.unionByName(swapped)
    kept = [c for c in docs.columns if c != "n_replaced"]
    return out.select(*[F.col("_new.text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in kept], F.col("_new.n_replaced").alias("n_replaced"))


def digest(docs: DataFrame) -> DataFrame:
    return pseudonymise(docs.select("doc_id", "text"))
