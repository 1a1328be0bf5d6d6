"""Personal data replaced by surrogates.

Entities are found in whole texts; each gets a replacement that a keyed hash
draws for its kind and canonical spelling. A replacement has the kind's format:
digits for digits, the same separators and letter case, a valid check digit
where there was one, a private address for a private one, a name of the same
gender and script. One entity has one replacement in all documents.

Distinct entities may draw the same replacement, or one that is somebody's real
datum. All entities of the corpus are therefore compared: of those that share a
replacement one keeps it, the others, and those that hit a real entity, draw
again. Where a format is nearly used up, those left draw many replacements at once and
share out the free ones; where a few thousand draws find none, the replacement gets
longer (a name, a number, a mailbox, a secret), so there is always one. Only entities that had to draw again are handed to the
documents, by a join; everything else a task draws by itself.

* Null texts count as empty and become empty; texts without entities do not change.
* Kinds: email, ip, card (12 to 19 digits), phone, iban, secret, given name, surname.
  Names are recognised behind or before a form of address; a name that is
  recognised is replaced throughout its document.
* Texts are read whole, whatever their length. Repeated rows are replaced alike. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import whole
from larder.session import materialise

# Stands for the secret of an installation.
KEY = "larder-surrogates"
# Draws one by one; after them entities still without a replacement choose among many draws at once.
DRAWS = 8
MANY = (64, 512, 4096)
# From this draw on a replacement is one character longer, from twice as many two.
LONGER = 1 << 20

# Forms of address by gender. Those of the last group follow the name.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Signor", "господин", "г-н", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "госпожа", "г-жа", "κυρία")
NEUTRAL = ("Dr", "Prof", "доктор")
MALE_AFTER, FEMALE_AFTER = ("先生",), ("女士", "小姐")
# Words around a secret.
SECRET_WORDS = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key", "key", "pwd")

# What makes a number beside it an amount.
CURRENCIES = ("EUR", "USD", "GBP", "CHF", "PLN", "CZK", "SEK", "NOK", "DKK", "HUF", "RUB", "JPY", "CNY", "INR", "zł", "Kč", "kr", "руб")
UNITS = (
    "km", "m", "cm", "mm", "ha", "kg", "g", "t", "l", "kWh", "MW", "GB", "MB", "KB", "bytes", "euros?", "dollars?", "pounds?", "yen", "roubles?",
    "people", "times", "years?", "habitantes", "habitants", "Einwohner", "inhabitants", "tons?", "tonnes?", "metres?", "meters?", "miles?")

# Syllables, and endings of given names by gender, for each script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le li lo ma me mi mo na ne no pa pe ra re ro sa se so ta te to va ve wi".split(),
    "cyrillic": "ба бе бо да де до за зо ка ко ла ле ли ло ма ме ми мо на не но па пе ра ре ро са се со та те то ва ве".split(),
    "greek": "βα βε γα δα δε θα θε κα κο λα λε λι μα με μι να νε νο πα πε ρα ρε ρο σα σε σο τα τε το φα".split(),
    "han": list("安白柏成达冬方丰光广海和洪江金可兰立林明木南宁平青清秋仁山石思松天文西小新星雪岩阳远云泽志中"),
}
ENDINGS = {
    "latin": {"m": ("ron", "bert", "mund", "rik", "las"), "f": ("lina", "rietta", "della", "rosa", "nia"), "": ("ren", "lis", "min")},
    "cyrillic": {"m": ("слав", "мир", "рин", "дор"), "f": ("лина", "слава", "рина", "мила"), "": ("ни", "ли")},
    "greek": {"m": ("νος", "ρης", "στος"), "f": ("νη", "λία", "ρία"), "": ("λι", "νι")},
    "han": {"m": ("刚", "强", "军", "伟"), "f": ("丽", "芳", "娜", "婷"), "": ("文", "华")},
}
FAMILY = {"latin": ("ner", "sen", "man", "ley", "do"), "cyrillic": ("нов", "рин", "ский", "енко"), "greek": ("δης", "κος", "λου"), "han": ("",)}

_LETTER = r"[^\W\d_]"
_NAME = rf"{_LETTER}[\w’'-]*"
_TITLED = re.compile(
    r"(?<!\w)(" + "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True)) + rf")(\.?[  ]+)({_NAME}(?:[  ]{_NAME}){{0,2}})")
_AFTER = re.compile(r"([一-鿿]{2,4}?)(" + "|".join((*MALE_AFTER, *FEMALE_AFTER)) + ")")
_TITLES = (*MALE, *FEMALE, *NEUTRAL, *MALE_AFTER, *FEMALE_AFTER)
_DOMAIN = re.compile(r"@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]*[A-Za-z0-9])+")
_NUMBER = re.compile(r"(?<![\w.])[+(]{0,2}\d[\d().\- ]*")
_NO_PHONE = re.compile(r"\d{4}[-. ]\d\d?[-. ]\d\d?|\d\d?[-. ]\d\d?[-. ]\d{4}|\d{1,3}(?: \d{3})+")
# Three groups of three digits are a phone number in some countries and an amount beside a unit or currency.
_THREES = re.compile(r"\d{3} \d{3} \d{3}")
_UNIT_BEFORE = re.compile(r"(?:[$€£¥₽]|\b(?:" + "|".join(CURRENCIES) + r"))[  ]?\Z")
_UNIT_AFTER = re.compile(r"[  ]?(?:[$€£¥₽%°²³]|(?:" + "|".join((*CURRENCIES, *UNITS)) + r")\b)|[.,]\d")
_IP = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)")
_IP6 = re.compile(r"(?<![\w:])[0-9a-fA-F:]{3,}+(?!\w)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SECRET = re.compile(r"[=:]\s*[\"']?([A-Za-z0-9_+/=.\-]{8,})")
_SECRET_WORD = re.compile(rf"(?:{'|'.join(SECRET_WORDS)})[\"']?\s*\Z", re.IGNORECASE)
_DIGIT = re.compile("[0-9]")
_LONG = re.compile(r"[A-Za-z0-9_+/-]{24,}", re.ASCII)


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _is_ip6(run: str) -> bool:
    """Whether a run of hex digits and colons is an address; two groups without a digit are names (``a::b``)."""
    if len(run) > 39 or run.count(":") < 2 or (run.count(":") == 2 and not _DIGIT.search(run)):
        return False
    try:
        ipaddress.IPv6Address(run)
    except ValueError:
        return False
    return True


def _amount(text: str, start: int, end: int) -> bool:
    """Whether a number is a date or amount by its form and by what is beside it."""
    if _THREES.fullmatch(text, start, end):
        return bool(_UNIT_BEFORE.search(text, max(0, start - 5), start) or _UNIT_AFTER.match(text, end))
    return bool(_NO_PHONE.fullmatch(text, start, end))


def script(word: str) -> str:
    for c in word:
        name = unicodedata.name(c, "")
        for key, start in (("cyrillic", "CYRILLIC"), ("greek", "GREEK"), ("han", "CJK")):
            if name.startswith(start):
                return key
    return "latin"


def _plain(kind: str, text: str) -> str:
    if kind in ("phone", "card"):
        return re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "secret":
        return text
    return text.casefold()


def entities(text: str) -> list[tuple]:
    """(start, end, kind, hint, canon) of a text, in order, without overlaps; earlier kinds win.

    ``hint`` is the gender of a given name.
    """
    found, taken = [], bytearray()

    def add(start: int, end: int, kind: str, hint: str = "") -> None:
        if not taken:
            taken.extend(bytes(len(text)))
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            found.append((start, end, kind, hint, _plain(kind, text[start:end])))

    if "@" in text:
        for m in _at_signs(text):
            add(*m, "email")
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            if _SECRET_WORD.search(text, max(0, m.start() - 24), m.start()):
                add(*m.span(1), "secret")
    if _DIGIT.search(text):
        _numeric(text, add)
    if text.count(":") > 1:
        for m in _IP6.finditer(text):
            found_ip = m[0] if m[0].endswith("::") else m[0].removesuffix(":")
            if _is_ip6(found_ip):
                add(m.start(), m.start() + len(found_ip), "ip")
    if any(t in text for t in _TITLES):
        _names(text, add)
    return sorted(found)


def _numeric(text: str, add) -> None:
    for m in _LONG.finditer(text):
        mixed = any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])
        if mixed and not _IBAN.fullmatch(m[0]):
            add(*m.span(), "secret")
    for m in _IBAN.finditer(text):
        if _iban_rest(m[0].replace(" ", "")) == 1:
            add(*m.span(), "iban")
    if text.count(".") > 2:
        for m in _IP.finditer(text):
            if all(int(part) < 256 for part in m[0].split(".")):
                add(*m.span(), "ip")
    for m in _NUMBER.finditer(text):
        for start, end in _numbers(m):
            digits = re.sub(r"\D", "", text[start:end])
            if 12 <= len(digits) <= 19 and not text[start:end].startswith(("+", "(")):
                add(start, end, "card")
            elif 7 <= len(digits) <= 15 and (len(digits) > 8 or not text[start:end].isdigit()) and not (
                    _amount(text, start, end)):
                add(start, end, "phone")


def _at_signs(text: str):
    """Email addresses, searched around each @ only."""
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        while start < at and not (text[start].isalnum() or text[start] == "_"):
            start += 1
        m = _DOMAIN.match(text, at)
        if m and start < at:
            yield start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def _numbers(match: re.Match):
    """Numbers inside a run of digits and separators: spaces between two long numbers part them."""
    text, base = match[0].rstrip("().- "), match.start()
    pieces = list(re.finditer(r"\S+", text))
    if len(text) == len(match[0]) and match.string[match.end():match.end() + 1].isalnum():
        pieces.pop()
    start = 0
    while start < len(pieces):
        end = start
        digits = last = len(re.sub(r"\D", "", pieces[start][0]))
        while end + 1 < len(pieces):
            more = len(re.sub(r"\D", "", pieces[end + 1][0]))
            if digits + more > 19 or last >= 9 or more >= 9:
                break
            digits, last, end = digits + more, more, end + 1
        yield base + pieces[start].start(), base + pieces[end].end()
        start = end + 1


def _names(text: str, add) -> None:
    parts: dict[str, tuple[str, str]] = {}
    for m in _TITLED.finditer(text):
        gender = "m" if m[1] in MALE else "f" if m[1] in FEMALE else ""
        names = []
        for word in re.split(r"[  ]", m[3]):
            if not word[:1].isupper():
                break
            names.append(word.rstrip("’'-"))
        for i, word in enumerate(names):
            given = len(names) > 1 and i < len(names) - 1
            parts.setdefault(word, ("given", gender) if given else ("surname", ""))
    for m in _AFTER.finditer(text):
        gender = "m" if m[2] in MALE_AFTER else "f"
        parts.setdefault(m[1][:1], ("surname", ""))
        parts.setdefault(m[1][1:], ("given", gender))
    if not parts:
        return
    latin = [p for p in parts if script(p) != "han"]
    if latin:
        words = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(p) for p in sorted(latin, key=len, reverse=True)) + r")(?!\w)")
        for m in words.finditer(text):
            add(*m.span(), *parts[m[0]])
    for m in _AFTER.finditer(text):
        start = m.start(1)
        add(start, start + 1, *parts[m[1][:1]])
        add(start + 1, m.end(1), *parts[m[1][1:]])


class Draw:
    """A keyed stream of small numbers."""

    def __init__(self, key: str, *parts):
        self.key, self.seed, self.block, self.bytes = key.encode(), "\x1f".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.bytes) < 4:
            self.bytes += hmac.new(self.key, self.seed + b"\x1e%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        value, self.bytes = int.from_bytes(self.bytes[:4], "big"), self.bytes[4:]
        return value % n

    def like(self, text: str) -> str:
        """Letters for letters of the same case, digits for digits, all else kept."""
        low, high, dec = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) and re.search(r"\d", text):
            hexa = "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"
            return "".join(hexa[self.below(16)] for _ in text)
        return "".join(
            dec[self.below(10)] if c.isdigit() else (high if c.isupper() else low)[self.below(26)] if c.isalpha() else c for c in text)


def surrogate(key: str, kind: str, hint: str, canon: str, draw: int = 0) -> str:
    """Replacement of an entity in canonical spelling, the ``draw``-th one."""
    rng, more = Draw(key, kind, canon, draw), draw // LONGER
    if kind in ("phone", "card"):
        digits = str(1 + rng.below(9)) + "".join(str(rng.below(10)) for _ in range(len(canon) - 1 + more))
        if kind == "card":
            digits = next(digits[:-1] + str(d) for d in range(10) if luhn(digits[:-1] + str(d)))
            if not luhn(canon):
                digits = digits[:-1] + str((int(digits[-1]) + 1 + rng.below(9)) % 10)
        return digits
    if kind == "ip":
        return _address(rng, canon)
    if kind == "iban":
        body = "".join(str(rng.below(10)) if c.isdigit() else chr(65 + rng.below(26)) for c in canon[4:])
        return f"{canon[:2]}{98 - _iban_rest(canon[:2] + '00' + body):02d}{body}"
    if kind == "email":
        local, domain = canon.rsplit("@", 1)
        named = Draw(key, "domain", domain, 0)
        labels = domain.split(".")
        return rng.like(local + "a" * more) + "@" + ".".join([*(named.like(part) for part in labels[:-1]), labels[-1]])
    if kind == "secret":
        return rng.like(canon + "0" * more)
    more = min(draw // 8, 4) if draw < LONGER else more + 4
    table = SYLLABLES[script(canon)]
    if script(canon) == "han":
        body = "".join(table[rng.below(len(table))] for _ in range(max(1, len(canon) - (kind == "given")) + more))
    else:
        body = "".join(table[rng.below(len(table))] for _ in range(2 + more + (kind == "surname")))
    ends = ENDINGS[script(canon)][hint] if kind == "given" else FAMILY[script(canon)]
    return body + ends[rng.below(len(ends))]


def _address(rng: Draw, canon: str) -> str:
    address = ipaddress.ip_address(canon)
    if address.version == 6:
        net = "fd" if address.is_private else "2001:"
        tail = [f"{rng.below(65536):x}" for _ in range(7)]
        return ":".join([f"fd{rng.below(256):02x}", *tail]) if net == "fd" else ":".join(["2001", *tail])
    while True:
        parts = [1 + rng.below(223), rng.below(256), rng.below(256), 1 + rng.below(254)]
        if address.is_private:
            parts[0] = 10
        out = ".".join(map(str, parts))
        if ipaddress.ip_address(out).is_private == address.is_private:
            return out


def fit(original: str, kind: str, replacement: str) -> str:
    """The canonical replacement in the spelling of the place: separators and letter case."""
    if kind in ("phone", "card", "iban"):
        left = iter(replacement)
        return "".join(next(left) if c.isalnum() else c for c in original) + "".join(left)
    if kind in ("given", "surname"):
        if original.isupper() and len(original) > 1:
            return replacement.upper()
        return replacement[:1].upper() + replacement[1:] if original[:1].isupper() else replacement
    if kind == "email" and len(original) == len(replacement):
        return "".join(r.upper() if o.isupper() else r for o, r in zip(original, replacement))
    return replacement


def rewrite(text: str, key: str = KEY, settled: dict[tuple[str, str], tuple[str, int]] | None = None) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds found.

    ``settled`` has gender and draw of entities for which the corpus decides:
    names with a gender and whatever collided.
    """
    out, at, kinds = [], 0, []
    for start, end, kind, hint, canon in entities(text):
        hint, draw = (settled or {}).get((kind, canon), (hint, 0))
        out += [text[at:start], fit(text[start:end], kind, surrogate(key, kind, hint, canon, draw))]
        at = end
        kinds.append(kind)
    return "".join([*out, text[at:]]), kinds


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, body and row: a digest of id and text, the same in every scan. Repeated rows share it."""
    body = whole()
    return docs.select("doc_id", body.alias("body"), F.unhex(F.sha2(F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), body), 256)).alias("row"))


def mentions(docs: DataFrame) -> DataFrame:
    """row, kind, hint and canon of the distinct entities of every document."""

    def find(batches):
        for batch in batches:
            rows, got = [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for item in sorted({e[2:] for e in entities(text.as_py())}):
                    rows.append(row)
                    got.append(item)
            yield pa.record_batch([pa.array(rows, pa.binary()), *(pa.array([g[i] for g in got], pa.string()) for i in range(3))],
                                  ["row", "kind", "hint", "canon"])

    return _named(docs).select("row", "body").mapInArrow(
        find, "row binary, kind string, hint string, canon string")


def assigned(found: DataFrame, key: str = KEY, collide=surrogate) -> DataFrame:
    """kind, hint, canon, draw and surrogate of every entity; surrogates of a kind are distinct and no one's real datum."""

    def drawn(kind: pa.Array, hint: pa.Array, canon: pa.Array, draw: pa.Array) -> pa.Array:
        return pa.array([collide(key, *row) for row in zip(*(c.to_pylist() for c in (kind, hint, canon, draw)))], pa.string())

    draw = F.arrow_udf(drawn, "string")("kind", "hint", "canon", "draw")
    entity = ("kind", "hint", "canon", "draw", "surrogate")
    # A name met with different forms of address is one entity; a known gender wins.
    state = materialise(found.groupBy("kind", "canon").agg(F.max("hint").alias("hint")).withColumn(
        "draw", F.lit(0)).withColumn("surrogate", draw), "entities")
    real = state.select("kind", F.col("canon").alias("seen"))

    def seen(rows: DataFrame) -> DataFrame:
        return rows.withColumn("seen", F.when(F.col("kind").isin("secret"), F.col("surrogate")).otherwise(F.lower("surrogate")))

    def judge(rows: DataFrame) -> DataFrame:
        """``redo``: the replacement is another entity's, or a real datum."""
        folded = seen(rows)
        shared = folded.groupBy("kind", "seen").agg(
            F.count("*").alias("n"), F.min(F.struct("draw", "canon")).alias("owner")).where("n > 1")
        hit = folded.join(shared, ["kind", "seen"], "left").join(real.withColumn("real", F.lit(True)), ["kind", "seen"], "left")
        redo = F.coalesce("real", F.lit(False)) | (F.col("n").isNotNull() & (F.col("owner.canon") != F.col("canon")))
        return materialise(hit.select(*entity, redo.alias("redo")), "judged")

    def again(judged: DataFrame, number: Column) -> DataFrame:
        return materialise(judged.where("not redo").drop("redo").unionByName(judged.where("redo").select(
            "kind", "hint", "canon", number.cast("int").alias("draw")).withColumn("surrogate", draw)), "entities")

    while True:
        for _ in range(DRAWS):
            judged = judge(state)
            if judged.where("redo").isEmpty():
                return judged.drop("redo")
            state = again(judged, F.col("draw") + 1)
        judged = judge(state)
        kept, left = judged.where("not redo").drop("redo"), judged.where("redo").select("kind", "hint", "canon", "draw")
        for many in MANY:
            while not left.isEmpty():
                offers = seen(left.withColumn("draw", F.explode(F.sequence(F.col("draw") + 1, F.col("draw") + many))).withColumn(
                    "surrogate", draw))
                free = offers.join(seen(kept).select("kind", "seen"), ["kind", "seen"], "left_anti").join(
                    real, ["kind", "seen"], "left_anti")
                # A free replacement goes to one of those that drew it, by hash; each takes the first it got.
                mine = free.groupBy("kind", "seen").agg(F.min_by(F.struct(*entity), F.xxhash64("seen", "canon", "draw")).alias("e"))
                took = materialise(mine.groupBy(F.col("e.kind").alias("kind"), F.col("e.canon").alias("canon")).agg(
                    F.min_by("e", "e.draw").alias("e")).select("e.*"), "taken")
                if took.isEmpty():
                    break
                kept = materialise(kept.unionByName(took), "entities")
                left = materialise(left.join(took, ["kind", "canon"], "left_anti").withColumn("draw", F.col("draw") + many), "left")
        if left.isEmpty():
            return kept
        # These formats are full: the rest of their entities get longer replacements.
        longer = (F.floor(F.col("draw") / LONGER) + 1) * LONGER
        state = again(kept.withColumn("redo", F.lit(False)).unionByName(
            left.withColumn("surrogate", F.lit("")).withColumn("redo", F.lit(True))), longer)


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text (with surrogates), n_entities and kinds (sorted, with commas) of every document."""
    found = materialise(mentions(docs), "mentions")
    again = assigned(found, key).where("draw > 0 or hint <> ''").select("kind", "canon", "hint", "draw")
    per_row = materialise(found.select("row", "kind", "canon").distinct().join(again, ["kind", "canon"]).groupBy("row").agg(
        F.collect_list(F.struct("kind", "canon", "hint", "draw")).alias("again")), "again")

    def change(texts: pa.Array, again: pa.Array) -> pa.Array:
        out = []
        for text, listed in zip(texts, again.to_pylist()):
            draws = {(a["kind"], a["canon"]): (a["hint"], a["draw"]) for a in listed or ()}
            new, kinds = rewrite(text.as_py(), key, draws)
            out.append({"text": new, "n": len(kinds), "kinds": ",".join(sorted(set(kinds)))})
        return pa.array(out, pa.struct([("text", pa.string()), ("n", pa.int64()), ("kinds", pa.string())]))

    made = F.arrow_udf(change, "text string, n long, kinds string")("body", "again")
    return _named(docs).join(per_row, "row", "left").select("doc_id", made.alias("made")).select(
        "doc_id", "made.text", F.col("made.n").alias("n_entities"), "made.kinds")
