"""Secret scans through a trigram inverted index. DataFrame functions only.

For each rule a Boolean trigram query is derived from its parsed regular expression: an alternative for each way
through it, of all trigrams of the literal stretches on that way, as a text that matches must hold them. The index
has the postings (trigram, document) of the trigrams in any query; the lists of an alternative's trigrams are
intersected, those of a rule's alternatives united, and only candidates are verified with the expression itself.
Rules with a way without a trigram scan every text.

Matches are leftmost and not overlapping for each rule; those that fail the rule's least length are dropped.
Null texts are empty. Positions are code points, end exclusive. Ids may be null, and rows may repeat: postings
are kept by a hash of id and text, whose collisions only add candidates. Other columns, whatever their names, stay as
they are in `redact` and are ignored in `report`.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearvote.llm.arrays import once, running, stretches


#: Ways through an expression that are followed apart; beyond them, what branches counts as any text.
MOST_WAYS = 64
#: Stands for any text in a way.
ANY = "\0"


def ways_of(parsed) -> list[str]:
    """The ways through a parsed expression: literal text, in lower case, with ANY for what is not fixed."""
    out = [""]
    for op, arg in parsed:
        name, own = str(op), [ANY]
        if name == "LITERAL":
            own = [chr(arg).lower()]
        elif name == "IN" and all(str(kind) == "LITERAL" for kind, _ in arg):
            own = sorted({chr(c).lower() for _, c in arg})
        elif name == "SUBPATTERN":
            own = ways_of(arg[3])
        elif name == "BRANCH":
            own = [way for branch in arg[1] for way in ways_of(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, body = arg
            once = ways_of(body)
            own = [ANY] if not least and most != 1 else ["", *once] if not least else once if most == 1 else [way + ANY for way in once]
        elif name == "AT":  # an edge takes no text
            own = [""]
        out = list(dict.fromkeys(a + b for a in out for b in (own if len(out) * len(own) <= MOST_WAYS else [ANY])))
    return out


@dataclass(frozen=True)
class Rule:
    """pattern: in the common syntax of Java, RE2 and Python. group, least: that group needs so many characters.
    base: the contract's own rule."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False

    def query(self) -> list[list[str]]:
        """Any of the lists of trigrams has to be held in full; no list: every text is a candidate."""
        ways = {frozenset(x[i : i + 3] for x in way.split(ANY) for i in range(len(x) - 2)) for way in ways_of(_parser.parse(self.pattern))}
        return sorted(sorted(w) for w in ways if not any(x < w for x in ways)) if all(ways) else []


#: Fixed values; the order is that of kinds on equal starts. A run of 24 or more is what a longest run of one or
#: more gives after those under 24 are dropped. Repeats that could be begun anew at each character are bounded.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{1,512}\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("url_login", r"[a-z]{1,16}://[A-Za-z0-9._~-]+:[^\x09-\x0D\x20@/]+@", 0, 12),
)
SPAN = "struct<start:bigint,kind_order:int,kind:string,end:bigint>"


def spans_of(rule: Rule, order: int, text: Column) -> Column:
    """An array of SPAN. Pieces between matches and matches alternate, so their lengths give the positions."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    least = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    sizes = lambda x: F.transform(x, lambda y: F.length(y).cast("long"))
    # Split at -1 keeps empty pieces, also the last, which has no match.
    both = F.filter(F.arrays_zip(sizes(F.split(text, rule.pattern, -1)).alias("gap"), sizes(found).alias("len"), sizes(least).alias("least")), lambda x: x["len"].isNotNull())

    def placed(m: Column) -> Column:
        before = running(F.transform(m, lambda x: x["gap"] + x["len"]), lambda x, y: x + y, 0)
        span = lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), (at + x["gap"] + x["len"]).alias("end"), (x["least"] >= rule.least).alias("ok"))
        kept = F.filter(F.zip_with(m, before, span), lambda x: x["ok"])
        return F.transform(kept, lambda x: F.struct(*(x[c].alias(c) for c in ("start", "kind_order", "kind", "end"))))

    return once(both, placed)


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """(trigram, key) for each trigram of a query and each document (key, text) that holds it."""
    grams = sorted({g for rule in rules for way in rule.query() for g in way})
    if not grams:
        return docs.select(F.lit("").alias("trigram"), "key").limit(0)
    lower = F.lower("text")
    held = F.filter(F.array(*(F.when(F.contains(F.col("lower"), F.lit(g)), F.lit(g)) for g in grams)), lambda x: x.isNotNull())
    return docs.select("key", lower.alias("lower")).select(F.explode(held).alias("trigram"), "key")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(key, rules): the numbers of the rules whose query the postings `index` meet.

    Each posting goes to the alternatives that have its trigram, with the trigram's place there as a bit; an
    alternative's lists have those documents in common that have all its bits. The table of alternatives is the
    rules' own, and bits are joined before anything is shuffled."""
    ways = [(rule, grams) for rule, r in enumerate(rules) for grams in r.query()]
    terms = [(gram, way, 1 << at) for way, (_, grams) in enumerate(ways) for at, gram in enumerate(grams)]
    assert all(len(grams) < 63 for _, grams in ways)
    if not ways:
        return index.select("key", F.array(F.lit(0)).alias("rules")).limit(0)
    by_gram = F.create_map(*(x for gram in sorted({t[0] for t in terms}) for x in (F.lit(gram), F.array(*(F.struct(F.lit(way).alias("way"), F.lit(bit).cast("long").alias("bit")) for g, way, bit in terms if g == gram)))))
    met = index.select("key", F.explode(F.element_at(by_gram, F.col("trigram"))).alias("t")).groupBy("key", F.col("t.way").alias("way")).agg(F.bit_or("t.bit").alias("bits"))
    whole = F.array(*(F.lit((1 << len(grams)) - 1).cast("long") for _, grams in ways))
    rule = F.element_at(F.array(*(F.lit(rule) for rule, _ in ways)), F.col("way") + 1)
    return met.where(F.col("bits") == F.element_at(whole, F.col("way") + 1)).groupBy("key").agg(F.collect_set(rule).alias("rules"))


def _fresh(name: str, columns: list[str]) -> str:
    """`name`, or one like it that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def scan(documents: DataFrame, rules=RULES, into: str = "secret_spans") -> DataFrame:
    """All columns of documents and `into`, an array of SPAN sorted by start, then kind. `into` is to be a new name."""
    key, held, which = (_fresh(x, documents.columns) for x in ("_key", "_held", "_rules"))
    keyed, text = documents.withColumn(key, F.xxhash64("doc_id", "text")), F.coalesce(F.col("text"), F.lit(""))
    found = candidates(postings(keyed.select(F.col(key).alias("key"), text.alias("text")), rules), rules)
    found = found.groupBy(F.col("key").alias(held)).agg(F.first("rules").alias(which))
    joined = keyed.join(found, F.col(key) == F.col(held), "left")
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    parts = []
    for i, rule in enumerate(rules):
        spans = spans_of(rule, i, text)
        parts.append(F.when(F.array_contains(which, i), spans).otherwise(none) if rule.query() else spans)
    return joined.withColumn(into, F.array_sort(F.flatten(F.array(*parts)))).drop(key, held, which)


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = [r.kind for r in RULES if r.base]
    return scan(documents.select("doc_id", "text")).select("doc_id", *map(count, base), F.sha2(as_text(F.filter(spans, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), as_text(spans).alias("spans"))


def _cut_out(text: Column, spans: Column, mark: str) -> Column:
    """text with `mark` in place of its spans, sorted by start; those that overlap or touch are one."""

    def around(before: Column) -> Column:
        """What stays, as (start, length); before: by span, the largest end before it."""
        both = F.zip_with(spans, before, lambda s, top: F.struct(s["start"].alias("start"), top.alias("top"), (s["start"] > top).alias("new")))
        heads = F.filter(both, lambda x: x["new"])
        # From the end of a group, 0 at first, to the start of the next one, or the text's end.
        begins = F.concat(F.array(F.lit(0).cast("long")), F.slice(F.transform(heads, lambda x: x["top"]), 2, F.greatest(F.size(heads) - 1, F.lit(0))), F.array(F.array_max(F.transform(spans, lambda s: s["end"]))))
        return F.zip_with(begins, F.concat(F.transform(heads, lambda x: x["start"]), F.array(F.length(text).cast("long"))), lambda at, to: F.struct(at.alias("start"), (to - at).alias("length")))

    tops = running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y), -1)
    return F.array_join(stretches(text, once(tops, around)), mark)


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of documents with all their columns; spans in `text` are replaced by `mark` (overlapping ones
    by one mark), and n_chars, if there, is that of the new text."""
    found = _fresh("secret_spans", documents.columns)
    clean = scan(documents, into=found)
    text = F.when(F.size(found) > 0, _cut_out(F.col("text"), F.col(found), mark)).otherwise(F.col("text"))
    clean = clean.withColumn("text", text)
    if "n_chars" in documents.columns:
        clean = clean.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*documents.columns)
