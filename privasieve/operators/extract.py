"""Text extraction: each format becomes an array of fragments inside the document's row.

A fragment is struct<text, value_start, value_end, ...>: what goes into the text, and where its
value lies in the fragment. `with_text` joins the fragments and places them in the document.
"""

from __future__ import annotations

import html.entities
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import MARK, collapse, empty, fold_blocks, latest, let, lines, lstrip, preceding, running_starts, searchable, strip

DELIMITERS = (",", ";", "\t", "|")
FIELD_HEADERS = ("field", "field name", "label", "key", "attribute", "property")
VALUE_HEADERS = ("value", "data", "content")
FRAGMENT = "struct<text:string,value_at:int,path:string,label:string,label_path:string,label_label:string>"


def fragment_offsets(fragments: Column) -> Column:
    """Start of every fragment in the joined text: earlier lengths and one line feed each."""
    return running_starts(F.transform(fragments, lambda f: F.length(f) + 1))


def join_fragments(fragments: Column, max_chars: int | None = None) -> Column:
    text = F.array_join(fragments, "\n")
    return text if max_chars is None else F.substring(text, 1, max_chars)


def place(fragments: Column) -> Column:
    """Fragments with their value's span in the joined text."""

    def located(starts: Column) -> Column:
        return F.transform(
            fragments,
            lambda f, i: F.struct(
                (i + 1).alias("ordinal"),
                f["text"].alias("fragment"),
                (starts[i] + f["value_at"]).alias("value_start"),
                (starts[i] + F.length(f["text"])).alias("value_end"),
                f["path"].alias("path"),
                f["label"].alias("label"),
            ),
        )

    return F.when(F.size(fragments) == 0, empty(
        "struct<ordinal:int,fragment:string,value_start:int,value_end:int,path:string,label:string>"
    )).otherwise(let(fragment_offsets(F.transform(fragments, lambda f: f["text"])), located))


def _fragment(label: Column, value: Column, path: Column, block: Column, label_path: Column | None = None, label_block: Column | None = None) -> Column:
    """What goes into the text. A label that stands in a cell of its own has a place of its own."""
    has = F.coalesce(label, F.lit("")) != ""
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(has, F.concat(label, F.lit(": "), value)).otherwise(value).alias("text"),
        F.when(has, F.length(label) + 2).otherwise(0).alias("value_at"),
        path.alias("path"),
        block.alias("label"),
        (none if label_path is None else label_path).alias("label_path"),
        (none if label_block is None else label_block).alias("label_label"),
    )


LOCATION = "struct<start:int,end:int,path:string,label:string>"


def locations(fragments: Column) -> Column:
    """Where the values, and the labels with a cell of their own, lie in the joined text: spans by start that do not overlap."""

    def spans(starts: Column) -> Column:
        def of_one(f: Column, i: Column) -> Column:
            first = F.get(starts, i)
            value = F.struct((first + f["value_at"]).alias("start"), (first + F.length(f["text"])).alias("end"), f["path"].alias("path"), f["label"].alias("label"))
            label = F.struct(first.alias("start"), (first + f["value_at"] - 2).alias("end"), f["label_path"].alias("path"), f["label_label"].alias("label"))
            return F.when(f["label_path"].isNull(), F.array(value)).otherwise(F.array(label, value))

        return F.flatten(F.transform(fragments, of_one)).cast(f"array<{LOCATION}>")

    return F.when(F.size(fragments) == 0, empty(LOCATION)).otherwise(let(fragment_offsets(F.transform(fragments, lambda f: f["text"])), spans))


def plain_text(text: Column) -> Column:
    """One location over a whole text: struct<start,end,line_starts>."""
    parts = F.split(searchable(text), "\n", -1)
    starts = running_starts(F.transform(parts, lambda p: F.length(p) + 1))
    return F.struct(
        F.lit(0).alias("start"), F.length(text).alias("end"),
        F.filter(starts, lambda s: (s == 0) | (s < F.length(text))).alias("line_starts"),
    )


# --- delimited ---------------------------------------------------------------------------------


def column_label(number: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA."""
    n = number.cast("int")

    def letter(x: Column) -> Column:
        return F.chr(65 + x % 26)

    return (
        F.when(n <= 26, letter(n - 1))
        .when(n <= 702, F.concat(letter(F.floor((n - 27) / 26)), letter(n - 1)))
        .otherwise(F.concat(letter(F.floor((n - 703) / 676)), letter(F.floor((n - 27) / 26)), letter(n - 1)))
    )


def _rows(text: Column, delimiter: str) -> Column:
    """Rows of cells. Quotes count at the start of a cell and may hold delimiters and line breaks."""
    d = "\\" + delimiter if delimiter == "|" else delimiter
    cell = rf'(?:"(?:[^"]++|"")*+"?+)?+[^{d}\r\n]*+'
    row = rf"{cell}(?:{d}{cell})*+(?:\r\n|\n|\r|\z)"

    def cells(line: Column) -> Column:
        # A delimiter in front makes every cell a match that is not empty.
        led = F.concat(F.lit(delimiter), F.regexp_replace(line, r"[\r\n]+\z", ""))
        found = F.regexp_extract_all(led, F.lit(d + cell), F.lit(0))

        def clean(c: Column) -> Column:
            body = F.substring(c, F.lit(2), F.length(c))
            quoted = F.regexp_extract(body, r'(?s)\A"((?:[^"]++|"")*+)"', 1)
            rest = F.regexp_replace(body, r'(?s)\A"(?:[^"]++|"")*+"', "")
            value = F.when(body.startswith('"'), F.concat(F.replace(quoted, F.lit('""'), F.lit('"')), rest)).otherwise(body)
            return strip(value)

        return F.transform(found, clean)

    found = F.regexp_extract_all(text, F.lit(row), F.lit(0))
    whole = F.filter(found, lambda r: r != "")
    return F.transform(whole, cells)


def _holding(delimiter: str):
    return lambda line: line.contains(delimiter)


def sniff_delimiter(text: Column) -> Column:
    """Of the delimiters in the first non-empty line the one that most lines have; then the one it has most of; then commas."""
    first = F.regexp_extract(text, r"(?m)^(.*\S.*)$", 1)
    counts = []
    for i, d in enumerate(DELIMITERS):
        n = F.length(F.regexp_replace(first, f"[^{d}]", ""))
        having = F.size(F.filter(F.split(text, "\n", -1), _holding(d)))
        counts.append(F.struct(F.when(n > 0, having).otherwise(0).alias("having"), n.alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")))
    return F.greatest(*counts)["d"]


def delimited(text: Column, tabs: bool = False) -> Column:
    """Cells of a delimited text. Under a header row each cell becomes `header: value`; a two-column
    field/value table becomes label/value pairs; a table without a header gives bare cells."""
    if tabs:
        rows = _rows(text, "\t")
    else:
        rows = let(sniff_delimiter(text), lambda d: F.coalesce(*[F.when(d == x, _rows(text, x)) for x in DELIMITERS]))

    def extract(table: Column) -> Column:
        filled = F.transform(table, lambda r: F.size(F.filter(r, lambda c: c != "")))
        first = F.array_position(F.transform(filled, lambda n: n > 0), F.lit(True)).cast("int")

        def with_header(head: Column) -> Column:
            known = (head > 0) & (F.get(filled, head - 1) >= 2)
            header = F.when(known, F.get(table, head - 1))
            names = F.transform(F.slice(header, F.lit(1), F.lit(2)), lambda h: F.lower(collapse(F.translate(h, "_-", "  "))))
            pairs = F.coalesce(F.get(names, F.lit(0)).isin(*FIELD_HEADERS) & F.get(names, F.lit(1)).isin(*VALUE_HEADERS), F.lit(False))

            def one(row: Column, number: Column) -> Column:
                used = F.filter(F.transform(row, lambda c, i: F.struct((i + 1).alias("column"), c.alias("value"))), lambda c: c["value"] != "")
                a, b = F.get(used, F.lit(0)), F.get(used, F.lit(1))

                def at(column: Column) -> tuple[Column, Column]:
                    spot = F.concat(F.lit("row "), number.cast("string"), F.lit(" column "), column_label(column))
                    return F.concat_ws(",", number.cast("string"), column.cast("string")), spot

                bare = F.transform(used, lambda c: _fragment(F.lit(None).cast("string"), c["value"], *at(c["column"])))
                titled = F.transform(used, lambda c: _fragment(F.get(header, c["column"] - 1), c["value"], *at(c["column"])))
                is_pair = (F.size(used) >= 2) & F.length(a["value"]).between(1, 72) & (F.length(b["value"]) >= 2) & ~a["value"].rlike("[:：]")
                pair = F.array(_fragment(a["value"], b["value"], *at(b["column"]), *at(a["column"])))
                body = F.when(known & ~pairs, titled).when(F.coalesce(is_pair, F.lit(False)), pair).otherwise(bare)
                return F.when(known & (number == head), F.filter(bare, lambda x: F.lit(False))).otherwise(body)

            return F.flatten(F.transform(table, lambda row, i: one(row, i + 1)))

        return let(first, with_header)

    return let(rows, extract)


# --- JSON --------------------------------------------------------------------------------------


_JSON_TOKEN = r'"(?:[^"\\]++|\\.)*+"|[{}\[\]:,]|[^\s{}\[\]:,"]++'
_OPEN = "array<struct<object:boolean,n:int,label:string,path:string,ordinal:string>>"
_LEAF = "struct<path:string,ordinal:string,label:string,value:string>"


def _plain_json(text: Column, per_line: bool = False) -> Column:
    """JSON texts, or the lines of files as one array, as strict JSON: the last value of a repeated key counts. Null for
    malformed texts."""

    def plain(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                value = None if text is None else [json.loads(line) for line in text] if per_line else json.loads(text)
                out.append(None if text is None else json.dumps(value, ensure_ascii=False))
            except (ValueError, RecursionError):
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(plain, StringType())(text)


def _sound(text: Column) -> Column:
    """Whether a text is one JSON value without repeated keys, with nothing behind it."""

    def alone(parsed: Column) -> Column:
        return F.try_variant_get(parsed, "$[0]", "variant").isNotNull() & F.try_variant_get(parsed, "$[1]", "variant").isNull()

    return F.coalesce(let(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), alone), F.lit(False))


def strict_json(text: Column) -> Column:
    """A JSON text without repeated keys; null for malformed JSON. Only texts that Spark's own parser refuses go to Python,
    where a repeated key is told from a malformed text."""
    fine = _sound(text)
    return F.when(fine, text).otherwise(_plain_json(F.when(fine, F.lit(None)).otherwise(text)))


def _json_string(token: Column) -> Column:
    inside = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(token.contains("\\"), F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), 0)).otherwise(inside)


def _json_leaves(value: Column) -> Column:
    """The scalars of one JSON value with the paths of their places: a fold over its tokens that keeps the open containers."""
    tokens = F.regexp_extract_all(value, F.lit(_JSON_TOKEN), F.lit(0))
    none = F.lit(None).cast("string")
    zero = {"open": F.array().cast(_OPEN), "key": F.lit(False)}

    def place(inner: Column) -> tuple[Column, Column, Column]:
        """Path, ordinal and label of the entry that the innermost container is at."""
        n = inner["n"].cast("string")
        path = F.concat(inner["path"], F.when(inner["object"], "/field[").otherwise("/item["), n, F.lit("]"))
        ordinal = F.when(inner["object"], F.concat_ws(".", F.nullif(inner["ordinal"], F.lit("")), n)).otherwise(inner["ordinal"])
        return F.coalesce(path, F.lit("")), F.coalesce(ordinal, F.lit("")), inner["label"]

    def step(acc: Column, token: Column) -> tuple[dict[str, Column], Column]:
        size = F.size(acc["open"])
        below = F.slice(acc["open"], F.lit(1), F.greatest(size - 1, F.lit(0)))
        top = F.get(acc["open"], size - 1)
        mark, comma, closes, opens = token.isin(",", ":"), token == ",", token.isin("}", "]"), token.isin("{", "[")
        key = acc["key"] & token.startswith('"')

        def counted(label: Column) -> Column:
            return F.struct(top["object"].alias("object"), (top["n"] + 1).alias("n"), label.alias("label"), top["path"].alias("path"), top["ordinal"].alias("ordinal"))

        # An item counts when its value begins, a field when its key is read.
        stays = (size == 0) | top["object"]
        entry = F.when(stays, top).otherwise(counted(top["label"]))
        current = F.when(stays, acc["open"]).otherwise(F.concat(below, F.array(counted(top["label"]))))

        def inner(e: Column) -> Column:
            path, ordinal, label = place(e)
            return F.struct((token == "{").alias("object"), F.lit(0).alias("n"), label.alias("label"), path.alias("path"), ordinal.alias("ordinal"))

        def leaf(e: Column) -> Column:
            path, ordinal, label = place(e)
            text = F.when(token.startswith('"'), _json_string(token)).when(token == "null", none).otherwise(token)
            return F.array(F.struct(path.alias("path"), ordinal.alias("ordinal"), label.alias("label"), text.alias("value")))

        fields = {
            "open": F.when(mark, acc["open"]).when(closes, below).when(key, F.concat(below, F.array(counted(_json_string(token)))))
            .when(opens, F.concat(current, F.array(let(entry, inner)))).otherwise(current),
            "key": F.when(comma, F.coalesce(top["object"], F.lit(False))).otherwise(token == "{"),
        }
        return fields, F.when(mark | closes | key | opens, empty(_LEAF)).otherwise(let(entry, leaf))

    return fold_blocks(tokens, zero, step, _LEAF)


def json_scalars(text: Column, records: bool | str = False) -> Column:
    """Scalars of a JSON value in document order as `key: value`; null for malformed JSON. A string is a scalar whatever it
    looks like; of a repeated key the last value counts, at the key's first place.

    The column may not stand inside a lambda, as it asks Python about texts that Spark's parser refuses.

    With `records` every line that is not empty is a value of its own, and one malformed line makes the file malformed. A name
    given as `records` ("jsonl", "ndjson") is told in the block labels.
    """
    values = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda v: v != "") if records else F.array(strip(text))
    if records:
        whole = F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))
        sound = F.forall(values, _sound)
        # Lines are parsed one by one, so that an array of them cannot close a broken line with the next one.
        strict = F.when(sound, whole).otherwise(_plain_json(F.when(sound, F.lit(None).cast("array<string>")).otherwise(values), per_line=True))
    else:
        strict = strict_json(text)
    kind = records.upper() if isinstance(records, str) else "JSON"

    def fragment(n: Column) -> Column:
        ordinal = F.when(n["ordinal"] == "", "value").otherwise(n["ordinal"])
        if not records:
            where, label = F.when(n["path"] == "", "/value").otherwise(n["path"]), F.concat(F.lit("JSON field "), ordinal)
        else:
            where = F.regexp_replace(n["path"], r"\A/item", "/record")
            number = F.regexp_extract(n["path"], r"\A/item\[(\d+)\]", 1)
            label = F.concat(F.lit(f"{kind} record "), number, F.lit(" field "), ordinal) if isinstance(records, str) else F.concat(F.lit("JSON field "), ordinal)
        return _fragment(n["label"], strip(n["value"]), where, label)

    leaves = F.filter(_json_leaves(strict), lambda n: F.coalesce(strip(n["value"]), F.lit("")) != "")
    return F.when(strict.isNotNull(), F.transform(leaves, fragment))


# --- XML and HTML ------------------------------------------------------------------------------

# Names that count without a semicolon too, by the HTML rules; the longest one at a place counts.
_BARE_NAMES = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=len, reverse=True)
_BARE = "|".join(_BARE_NAMES)
_ENTITY = rf"&(#[0-9]{{1,7}}+;?|#[xX][0-9A-Fa-f]{{1,6}}+;?|[A-Za-z][A-Za-z0-9]{{1,31}};|(?:{_BARE}))"
_COMMON = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "nbsp;": "\xa0", "apos;": "'"}


def _entities() -> Column:
    """All names as one constant, not as an expression of thousands of parts."""
    return F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")


def _code_point(code: Column) -> Column:
    """The character of a numeric reference, by the HTML rules for codes that name none."""
    digits = F.rtrim(F.substring(code, F.lit(2), F.length(code)), F.lit(";"))
    hexadecimal = F.lower(F.substring(code, 2, 1)) == "x"
    number = F.when(hexadecimal, F.conv(F.substring(digits, F.lit(2), F.length(digits)), 16, 10)).otherwise(digits).cast("long")
    # Codes of the C1 range name the characters of an old code page.
    windows = F.get(F.split(F.lit("\x1f".join(bytes([n]).decode("cp1252", "replace").replace("\ufffd", chr(n)) for n in range(0x80, 0xA0))), "\x1f"), (number - 0x80).cast("int"))
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    bad = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    nothing = number.between(1, 8) | number.between(14, 31) | number.between(127, 127) | number.isin(11, 0xFFFE, 0xFFFF)
    return F.when(bad, "\ufffd").when(number.between(0x80, 0x9F), windows).when(nothing, "").otherwise(plain)


def decode_entities(text: Column) -> Column:
    """Character references as their characters: numeric ones, names with a semicolon, and those that need none."""
    parts = F.split(F.regexp_replace(text, F.lit(_ENTITY), F.lit(f"{MARK}$1{MARK}")), MARK, -1)

    def character(code: Column) -> Column:
        named = F.coalesce(*(F.when(code == k, v) for k, v in _COMMON.items()), F.try_element_at(_entities(), code))
        start = F.regexp_extract(code, rf"\A(?:{_BARE})", 0)
        bare = F.concat(F.try_element_at(_entities(), start), F.substring(code, F.length(start) + 1, F.length(code)))
        return F.when(code.startswith("#"), _code_point(code)).otherwise(F.coalesce(named, bare, F.concat(F.lit("&"), code)))

    decoded = let(parts, lambda ps: F.array_join(F.transform(ps, lambda p, i: F.when(i % 2 == 1, character(p)).otherwise(p)), ""))
    return F.when(text.contains("&"), decoded).otherwise(text)


_HTML_TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)|<[!?][^>]*>|<script\b[^>]*>.*?(?=</script|\z)|<style\b[^>]*>.*?(?=</style|\z)|</?[a-z][^>]*>|[^<]+|<"
)


_NODE = "struct<value:string,tag:string,at:int,up:array<int>,key:string>"


def html_texts(text: Column) -> Column:
    """Text nodes with white space collapsed, in order, each with the path of the open tags around it. The content of script and
    style is text too, but its references are not decoded.

    A fold over the tokens keeps the stack of open tags. An end tag closes all up to the last open tag of its name (all, if
    there is none); tags without an end tag stay open until then. A tag's number counts the tags before it that have the same
    name and the same names around them. Numbers are told after the fold, by one sort over the tags.
    """
    tokens = F.regexp_extract_all(searchable(text), F.lit(_HTML_TOKEN), F.lit(0))

    def parsed(token: Column) -> Column:
        raw = F.regexp_extract(token, r"(?is)\A<(script|style)\b[^>]*>", 0)
        tag = F.lower(F.regexp_extract(token, r"(?i)\A</?([a-z][^\s/>]*)", 1))
        is_tag = token.rlike(r"(?i)\A<(?:[!?]|/?[a-z])")
        value = F.when(raw != "", F.substring(token, F.length(raw) + 1, F.length(token))).when(is_tag, F.lit("")).otherwise(decode_entities(token))
        return F.struct(
            tag.alias("tag"), collapse(value).alias("value"), token.startswith("</").alias("closing"),
            ((raw == "") & is_tag & token.endswith("/>")).alias("single"),
        )

    zero = {"names": F.array().cast("array<string>"), "ups": F.array().cast("array<int>"), "n": F.lit(0)}

    def step(acc: Column, token: Column) -> tuple[dict[str, Column], Column]:
        none, nowhere = F.lit(None).cast("string"), F.lit(None).cast("int")

        def node(value: Column, tag: Column, at: Column, up: Column, key: Column) -> Column:
            return F.struct(value.alias("value"), tag.alias("tag"), at.alias("at"), up.alias("up"), key.alias("key"))

        def words(up: Column) -> Column:
            return F.when(token["value"] != "", F.array(node(token["value"], none, nowhere, up, none))).otherwise(empty(_NODE))

        back = F.array_position(F.reverse(acc["names"]), token["tag"]).cast("int")
        left = F.when(back == 0, 0).otherwise(F.size(acc["names"]) - back)
        names, ups = F.concat(acc["names"], F.array(token["tag"])), F.concat(acc["ups"], F.array(acc["n"]))
        opens = (token["tag"] != "") & ~token["closing"]
        stays = opens & ~token["single"]
        fields = {
            "names": F.when(token["closing"], F.slice(acc["names"], F.lit(1), left)).when(stays, names).otherwise(acc["names"]),
            "ups": F.when(token["closing"], F.slice(acc["ups"], F.lit(1), left)).when(stays, ups).otherwise(acc["ups"]),
            "n": F.when(opens, acc["n"] + 1).otherwise(acc["n"]),
        }
        tag = F.array(node(none, token["tag"], acc["n"], ups, F.array_join(names, "/")))
        return fields, F.when(token["closing"], empty(_NODE)).when(opens, F.concat(tag, words(ups))).otherwise(words(acc["ups"]))

    def numbered(nodes: Column) -> Column:
        tags = F.filter(nodes, lambda x: x["tag"].isNotNull())
        texts = F.filter(nodes, lambda x: x["value"].isNotNull())
        by_key = F.sort_array(F.transform(tags, lambda x: F.struct(x["key"].alias("key"), x["at"].alias("at"))))

        def count(ordered: Column) -> Column:
            fresh = F.transform(ordered, lambda x, i: F.when((i == 0) | (F.get(ordered, i - 1)["key"] != x["key"]), i))
            def own(first: Column) -> Column:
                return F.transform(ordered, lambda x, i: F.struct(x["at"].alias("at"), (i - F.get(first, i) + 1).alias("number")))

            first = let(fresh, latest)
            return F.transform(F.sort_array(let(first, own)), lambda x: x["number"])

        def told(names: Column, numbers: Column) -> Column:
            def part(i: Column) -> Column:
                return F.concat(F.get(names, i), F.lit("["), F.get(numbers, i).cast("string"), F.lit("]"))

            def one(x: Column, i: Column) -> Column:
                inner = F.get(x["up"], F.size(x["up"]) - 1)
                label = F.when(inner.isNull(), F.concat(F.lit("HTML text "), (i + 1).cast("string"))).otherwise(
                    F.concat(F.lit("HTML "), F.get(names, inner), F.lit(" "), F.get(numbers, inner).cast("string")))
                path = F.concat(F.lit("/"), F.array_join(F.transform(x["up"], part), "/"))
                return _fragment(F.lit(None).cast("string"), x["value"], path, label)

            return F.transform(texts, one)

        return let(F.transform(tags, lambda x: x["tag"]), lambda names: let(F.when(F.size(by_key) == 0, F.array().cast("array<int>")).otherwise(let(by_key, count)), lambda numbers: told(names, numbers)))

    return let(fold_blocks(F.transform(tokens, parsed), zero, step, _NODE), numbered)


_XML_TAG = r"""<(?:[^<>"']++|"[^"]*+"|'[^']*+')++>"""
_XML_PART = rf"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>\[]*(?:\[.*?\]\s*)?>|{_XML_TAG}|[^<]++|<"""
_XML_TOKEN = rf"{_XML_TAG}[^<]*+"
_XML_HEAD = rf"\A({_XML_TAG})"


def xml_elements(text: Column) -> Column:
    """Tags and texts alone: comments, instructions and declarations go, CDATA becomes text."""

    def kept(part: Column) -> Column:
        data = F.substring(part, F.lit(10), F.length(part) - 12)
        escaped = F.replace(F.replace(data, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        return F.when(part.startswith("<![CDATA["), escaped).when(part.rlike(r"\A<[!?]"), "").otherwise(part)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_XML_PART), F.lit(0)), kept), "")


def well_formed(text: Column) -> Column:
    """Whether a text is one XML element with all tags closed in order, as Spark's own parser sees it."""
    parsed = F.from_xml(F.trim(text), "broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    return F.coalesce(text.rlike(r"\A\s*<"), F.lit(False)) & parsed.isNotNull() & parsed["broken"].isNull()


def xml_scalars(text: Column) -> Column:
    """Attributes and element texts as `name: value` with the element's ordinal path; null for malformed XML. Namespace
    declarations are no attributes.

    A fold over the tags keeps the path of open elements, so any nesting is walked in one pass, block by block.
    """
    tokens = F.regexp_extract_all(xml_elements(searchable(text)), F.lit(_XML_TOKEN), F.lit(0))
    zero = {"path": F.array().cast("array<int>"), "children": F.array(F.lit(0))}

    def local(name: Column) -> Column:
        return F.element_at(F.split(name, ":"), -1)

    def parsed(token: Column) -> Column:
        def parts(tag: Column) -> Column:
            head = F.substring(tag, F.lit(2), F.length(tag) - 2)
            pairs = F.regexp_extract_all(head, F.lit(r"""\s[^\s=]+\s*=\s*(?:"[^"]*"|'[^']*')"""), F.lit(0))
            pairs = F.filter(pairs, lambda x: ~x.rlike(r"\A\s+xmlns(?:\s*=|:)"))

            def attribute(x: Column) -> Column:
                quoted = F.regexp_extract(x, r"(?s)\A[^=]*=\s*(.*)\z", 1)
                return F.struct(
                    local(F.regexp_extract(x, r"\A\s([^\s=]+)", 1)).alias("name"),
                    collapse(decode_entities(F.regexp_replace(quoted, r"\A.|.\z", ""))).alias("value"),
                )

            return F.struct(
                tag.startswith("</").alias("closing"), head.endswith("/").alias("single"),
                local(F.regexp_extract(head, r"\A([^\s/]+)", 1)).alias("name"),
                collapse(decode_entities(F.substring(token, F.length(tag) + 1, F.length(token)))).alias("value"),
                F.transform(pairs, attribute).alias("attributes"),
            )

        return let(F.regexp_extract(token, _XML_HEAD, 1), parts)

    def step(acc: Column, token: Column) -> tuple[dict[str, Column], Column]:
        depth = F.size(acc["path"])
        me = F.element_at(acc["children"], -1) + 1
        siblings = F.concat(F.slice(acc["children"], F.lit(1), F.size(acc["children"]) - 1), F.array(me))

        def told(path: Column) -> Column:
            where = F.concat(F.lit("/"), F.array_join(F.transform(path, lambda p: F.concat(F.lit("element["), p.cast("string"), F.lit("]"))), "/"))
            ordinal = F.array_join(F.transform(path, lambda p: p.cast("string")), ".")
            attributes = F.filter(
                F.transform(
                    token["attributes"],
                    lambda x, i: _fragment(
                        x["name"], x["value"], F.concat(where, F.lit("/attribute["), (i + 1).cast("string"), F.lit("]")),
                        F.concat(F.lit("XML element "), ordinal, F.lit(" attribute "), (i + 1).cast("string"))),
                ),
                lambda f: F.length(f["text"]) > f["value_at"],
            )
            body = F.array(_fragment(token["name"], token["value"], where, F.concat(F.lit("XML element "), ordinal)))
            return F.concat(attributes, F.when((token["value"] != "") & ~token["single"], body).otherwise(empty(FRAGMENT)))

        inside = F.concat(acc["path"], F.array(me))
        fields = {
            "path": F.when(token["closing"], F.slice(acc["path"], F.lit(1), F.greatest(depth - 1, F.lit(0)))).when(token["single"], acc["path"]).otherwise(inside),
            "children": F.when(token["closing"], F.slice(acc["children"], F.lit(1), F.greatest(F.size(acc["children"]) - 1, F.lit(1))))
            .when(token["single"], siblings).otherwise(F.concat(siblings, F.array(F.lit(0)))),
        }
        return fields, F.when(token["closing"], empty(FRAGMENT)).otherwise(let(inside, told))

    return F.when(well_formed(text), fold_blocks(F.transform(tokens, parsed), zero, step, FRAGMENT))


# --- Markdown and transcripts ------------------------------------------------------------------


def pipe_cells(line: Column) -> Column:
    bare = strip(line)
    bare = F.regexp_replace(F.regexp_replace(bare, r"\A\|", ""), r"(?<!\\)\|\z", "")
    return F.transform(F.split(bare, r"(?<!\\)\|", -1), lambda c: strip(F.regexp_replace(c, r"\\(.)", "$1")))


def _is_rule(cells: Column) -> Column:
    """A separator row under a table header: at least two cells of three or more dashes."""
    used = F.filter(F.transform(cells, lambda c: F.replace(c, F.lit(" "), F.lit(""))), lambda c: c != "")
    return (F.size(used) >= 2) & F.forall(used, lambda c: c.rlike(r"\A:*-{3,}:*\z"))


def with_markdown(documents: DataFrame, text: str = "text", fragments: str = "fragments", indents: str | None = None) -> DataFrame:
    """Add `fragments`: pipe tables as `header: value` cells, other non-empty lines as they are. `indents` adds an array with
    the white space that was taken off the front of each line."""
    kept = documents.columns
    rows = documents.withColumn("_rows", lines(searchable(F.col(text))))
    parsed = F.transform("_rows", lambda r: F.struct(r["line"].alias("line"), r["line_number"].alias("number"), pipe_cells(r["line"]).alias("cells")))
    rows = rows.withColumn("_rows", parsed)
    # Lines of one unbroken run of pipe rows share a block number.
    pipe = F.transform("_rows", lambda r: r["line"].contains("|") & (F.size(r["cells"]) >= 2))
    rows = rows.withColumn("_pipe", pipe).withColumn("_rule", F.transform("_rows", lambda r: _is_rule(r["cells"])))
    rows = rows.withColumn("_block", F.when(F.size("_pipe") > 0, running_starts(F.transform("_pipe", lambda p: (~p).cast("int")))))
    headed = F.transform("_rows", lambda r, i: F.coalesce(F.get("_rule", i + 1), F.lit(False)) & (F.size(F.filter(r["cells"], lambda c: c != "")) >= 2))
    starts = F.filter(F.transform(headed, lambda h, i: F.when(h, i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_starts", starts)
    # The first table start of the line's block, if the line does not stand before it.
    of_block = F.transform("_starts", lambda s, n: F.when((n == 0) | (F.get("_block", F.get("_starts", n - 1)) != F.get("_block", s)), s))
    rows = rows.withColumn("_firsts", F.filter(of_block, lambda s: s.isNotNull()))
    rows = rows.withColumn("_before", preceding(F.col("_firsts"), F.transform("_rows", lambda r, i: i)))

    def head_of(r: Column, i: Column) -> Column:
        start = F.when(F.get("_before", i) >= 0, F.get("_firsts", F.get("_before", i)))
        return F.when(F.get("_block", start) == F.get("_block", i), start)

    first = F.transform("_rows", head_of)
    rows = rows.withColumn("_head", first)
    none = F.lit(None).cast("string")

    def one(r: Column, i: Column) -> Column:
        number, head, plain = r["number"].cast("string"), F.get("_head", i), strip(r["line"])
        line = F.filter(F.array(_fragment(none, plain, number, F.concat(F.lit("Line "), number))), lambda f: f["text"] != "")
        cells = F.transform(
            r["cells"],
            lambda c, j: _fragment(
                F.get(F.get("_rows", head)["cells"], j), c, F.concat_ws(",", number, (j + 1).cast("string")),
                F.concat(F.lit("row "), number, F.lit(" column "), column_label(j + 1))),
        )
        body = (i > head + 1) & ~F.get("_rule", i)
        used = F.filter(cells, lambda f: body & (F.length(f["text"]) > f["value_at"]))
        return F.when(head.isNull() | ~F.get("_pipe", i), line).otherwise(used)

    rows = rows.withColumn(fragments, F.flatten(F.transform("_rows", one)))
    if indents is None:
        return rows.select(*kept, fragments)
    taken = F.transform("_rows", lambda r: F.length(r["line"]) - F.length(lstrip(r["line"])))
    return rows.withColumn(indents, taken).select(*kept, fragments, indents)


def clean_transcript(text: Column) -> Column:
    """Spoken lines of a subtitle file: no header, numbers, or cue times."""
    spoken = F.transform(lines(searchable(text)), lambda ln: strip(ln["line"]))
    kept = F.filter(
        spoken,
        lambda s: (s != "") & (F.upper(s) != "WEBVTT") & ~s.rlike(r"\A\p{Nd}+\z") & ~s.contains("-->"),
    )
    return F.array_join(kept, "\n")


# --- outcomes ----------------------------------------------------------------------------------


def extracted(documents: DataFrame, fragments: Column, key: str = "doc_id") -> DataFrame:
    """One row per fragment with its place in the text of its document."""
    held = documents.select(key, F.explode(F.array(fragments)).alias("_fragments"))
    return held.select(key, F.inline(place(F.col("_fragments"))))


def with_outcome(documents: DataFrame, text: Column) -> DataFrame:
    """Extracted text, or the reason why there is none; a failing file never stops a job."""
    blank = F.coalesce(strip(text), F.lit("")) == ""
    return documents.withColumn("extracted_text", text).withColumn(
        "issue", F.when(F.col("extracted_text").isNull(), "malformed").when(blank, "no_text"))


def split_outcomes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable documents, and failures with their difficulty."""
    failed = documents.filter("issue is not null")
    difficulty = F.when(F.col("issue") == "no_text", "hard").otherwise("unsupported")
    return documents.filter("issue is null"), failed.withColumn("difficulty", difficulty)
