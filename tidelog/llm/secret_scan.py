"""Secret scans by linking the parts of a credential.

Each kind of part is found by one pass of a regular expression that brackets its matches with a private mark; the
lengths of the pieces between the marks, summed along the text by a window, are the positions. Parts then meet in an
interval join: secrets go to the cell of ``scope`` code points in which they start, identifiers and endpoints to theirs
and both its neighbours, and of what shares a document and a cell, starts at most ``scope`` apart are a link. A cell
holds at most ``scope`` starts of a kind, however many parts a document has. Strong parts are reported in any case; weak
ones only where a link names a complementary part.

=============  ==========  =======================================  ==================================
kind           part        what it is                               reported
=============  ==========  =======================================  ==================================
assign         secret      a named secret and its value             always
access         identifier  an access key id                         always
hex            secret      a long run of hexadecimal digits         always
weak_id        identifier  a named user, client or account          near a secret
weak_secret    secret      a shortly named value, an access key's   near an identifier or an endpoint
                           secret or a bare mixed token
endpoint       endpoint    a URL or a named host                    near a secret
=============  ==========  =======================================  ==================================

A bare mixed token is a run of at least 24 ASCII letters, digits, ``+``, ``/`` and ``=``. After its first 0, 7, 14 or 21
characters come an upper-case letter, a lower-case letter and a digit, each at most 33 characters behind the one before,
and then at least the rest of 21 characters. The shape needs no lookahead, which DuckDB's expressions don't have.
Of 20,000 random mixed tokens of 32 base64 characters it missed 0.005 %, of 40 or 64 characters none. A long path of
mixed characters in a URL has the shape too, and its own URL is an endpoint near it, so it is reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fingerprint, materialize, text_of


def _any_case(words: str) -> str:
    """The pattern with each lower-case ASCII letter in either case, for engines whose case folding goes beyond ASCII."""
    return "".join(f"[{c}{c.upper()}]" if c.isascii() and c.islower() else c for c in words)


def _mixed(most: int = 32, others: int = 21) -> str:
    """A run with an upper-case letter, a lower-case letter and a digit, and ``others`` more characters around these; repeats are bounded, so a start costs the same in a run of any length."""
    sign, kinds = "+/=", ("A-Z", "a-z", "0-9")
    ways = []
    for a in kinds:
        b, c = (k for k in kinds if k != a)
        ways.append(f"[{a}][{a}{sign}]{{0,{most}}}(?:[{b}][{a}{b}{sign}]{{0,{most}}}[{c}]|[{c}][{a}{c}{sign}]{{0,{most}}}[{b}])")
    run = f"[A-Za-z0-9{sign}]"
    return "|".join(f"{run}{{{n}}}(?:{'|'.join(ways)}){run}{{{others - n}}}" for n in range(0, others + 1, 7))


#: The shape of a bare mixed token.
MIXED = _mixed()
#: What any bare mixed token begins with; tried first, it keeps the shape's many ways away from ordinary words.
_LONG_RUN = "(?=[A-Za-z0-9+/=]{24})"
_IS = r"""["']?\x20*[:=]\x20*["']?"""
#: Fixed values. Each pattern has two groups: what leads to the value, and the value (of weak_secret: what decides, and the rest of the run); by their kinds in the order of ties.
PATTERNS = {
    "assign": f"({_any_case('(?:password|passwd|secret|token|api_?key)')}{_IS})([A-Za-z0-9+/_.=-]+)",
    "access": r"(AKIA)([A-Z0-9]{16,})",
    "hex": r"()([0-9a-f]{24,})",
    "weak_id": f"({_any_case('(?:user_?name|user|login|client_?id|account_?id|account)')}{_IS})([A-Za-z0-9_.@-]{{3,}})",
    "weak_secret": f"({_any_case('(?:pwd|passphrase|credential|private_?key|secret_?(?:access_?)?key|access_?key|auth)')}{_IS}[A-Za-z0-9+/_.=-]{{6}}|{_LONG_RUN}(?:{MIXED}))([A-Za-z0-9+/_.=-]*)",
    "endpoint": f"((?:[a-z][a-z0-9+]{{1,20}}://|{_any_case('(?:host|server|endpoint)')}{_IS}))([A-Za-z0-9][A-Za-z0-9.:/_-]{{2,}})",
}
PART = {"assign": "secret", "access": "identifier", "hex": "secret", "weak_id": "identifier", "weak_secret": "secret", "endpoint": "endpoint"}
STRONG = ("assign", "access", "hex")
LEAST_VALUE = {"assign": 6}
#: Code points of the private use area, put around matches; where a text has them itself they are replaced first by another one, which no pattern matches.
MARK, INNER, OTHER = "\ue000", "\ue001", "\ue002"


#: The last letters of all names that a value may follow, and what stands between; a text without a place like this has no named value.
_NAMED = f"""[dehlnrtyDEHLNRTY]{_IS[: _IS.index("[:=]") + 4]}"""


def _may(kind: str) -> Column:
    """Of the column text: it has what each match of the kind has in it, found by a cheap pass."""
    text = F.col("text")
    named = (text.contains(":") | text.contains("=")) & text.rlike(_NAMED)
    first = {"access": text.contains("AKIA"), "hex": text.rlike("[0-9a-f]{24}"), "endpoint": text.contains("://") | named, "weak_secret": named | text.rlike("[A-Za-z0-9+/=]{24}")}
    return first.get(kind, named)


def _has(*kinds: str) -> Column:
    """Of the column text: it has a match of one of the kinds."""
    return reduce(Column.__or__, [_may(k) & F.col("text").rlike(PATTERNS[k]) for k in kinds])


def _found(kind: str) -> Column:
    """Of the column text: the pieces around the matches of a kind, as (kind, piece, n, value): value is the length of the match's value, -1 for what lies between matches."""
    marked = F.regexp_replace("text", F.lit(PATTERNS[kind]), F.lit(f"{MARK}$1{INNER}$2{MARK}"))
    inner = lambda p: F.instr(p, INNER)
    return F.transform(
        F.split(marked, MARK, -1),
        lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("piece"), (F.length(p) - (inner(p) > 0).cast("int")).alias("n"), F.when(inner(p) > 0, F.length(p) - inner(p)).otherwise(-1).alias("value")),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    text = docs.select("doc_id", text_of().alias("text"))
    marked = F.col("text").contains(MARK) | F.col("text").contains(INNER)
    return text.select("doc_id", text_hash().alias("text_hash"), F.when(marked, F.translate("text", MARK + INNER, OTHER + OTHER)).otherwise(F.col("text")).alias("text"))


def text_hash(text: str = "text") -> Column:
    """What tells texts of one doc_id apart: 128 bits."""
    return F.struct(*(h.alias(name) for h, name in zip(fingerprint(text_of(text)), ("hi", "lo"))))


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kind, rank, start, stop, inside) of each part, in code points, stop exclusive; once for rows that repeat doc_id and text. ``inside``: it starts within a strong part. Texts that can have nothing to report are left out."""
    # A weak part is reported only near a complementary one: in a text without a strong one, both must be there.
    hits = _keyed(docs).filter(_has(*STRONG) | (_has("weak_id", "endpoint") & _has("weak_secret")))
    pieces = F.concat(*[F.when(_may(k), _found(k)).otherwise(F.array()) for k in PATTERNS])
    hits = hits.select("doc_id", "text_hash", pieces.alias("pieces")).dropDuplicates(["doc_id", "text_hash"])
    rows = hits.select("doc_id", "text_hash", F.inline("pieces"))
    along = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("piece")
    least = F.create_map(*[x for k in PATTERNS for x in (F.lit(k), F.lit(LEAST_VALUE.get(k, 0)))])
    rank = F.create_map(*[x for i, k in enumerate(PATTERNS) for x in (F.lit(k), F.lit(i))])
    spans = rows.withColumn("stop", F.sum("n").over(along)).filter(F.col("value") >= least[F.col("kind")])
    spans = spans.select("doc_id", "text_hash", "kind", rank[F.col("kind")].alias("rank"), (F.col("stop") - F.col("n")).alias("start"), "stop")
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    inside = F.max(F.when(F.col("kind").isin(list(STRONG)), F.col("stop"))).over(before) > F.col("start")
    return spans.withColumn("inside", F.coalesce(inside, F.lit(False)))


def linked_parts(found: DataFrame, scope: int) -> DataFrame:
    """Interval join of ``found``, a table of ``parts``: (doc_id, text_hash, secret, other) of each secret and identifier or endpoint of a text that start at most ``scope`` apart; both are (start, rank, kind, stop, reported), reported: strong or not inside a strong part."""
    reported = F.col("kind").isin(list(STRONG)) | ~F.col("inside")
    span = F.struct("start", "rank", "kind", "stop", reported.alias("reported"))
    is_secret = F.col("kind").isin([k for k in PATTERNS if PART[k] == "secret"])
    cell = F.floor(F.col("start") / (scope + 1))
    secrets = found.filter(is_secret).select("doc_id", "text_hash", cell.alias("cell"), span.alias("secret"))
    others = found.filter(~is_secret).select(F.col("doc_id").alias("o_id"), F.col("text_hash").alias("o_hash"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("o_cell"), span.alias("other"))
    same = F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("text_hash") == F.col("o_hash")) & (F.col("cell") == F.col("o_cell"))
    near = F.abs(F.col("secret.start") - F.col("other.start")) <= scope
    return secrets.join(others, same & near).select("doc_id", "text_hash", "secret", "other")


def _reports(docs: DataFrame, scope: int) -> DataFrame:
    """(f_id, f_hash, found, links), materialized, of each text with something to report. ``found``: its spans (start, rank, kind, stop) in order; ``links``: its pairs of linked spans that are both reported, (secret, other), in order."""
    found = materialize(parts(docs))
    pairs = linked_parts(found, scope)
    plain = lambda c: F.struct(*(F.col(f"{c}.{f}").alias(f) for f in ("start", "rank", "kind", "stop")))
    both = F.col("secret.reported") & F.col("other.reported")
    link = F.when(both, F.struct(plain("secret").alias("secret"), plain("other").alias("other")))
    first = F.struct(F.when(F.col("secret.reported"), plain("secret")).alias("span"), link.alias("link"))
    second = F.struct(F.when(F.col("other.reported"), plain("other")).alias("span"), F.lit(None).cast(pairs.select(link.alias("link")).schema["link"].dataType).alias("link"))
    ends = pairs.select("doc_id", "text_hash", F.inline(F.array(first, second)))
    strong = found.filter(F.col("kind").isin(list(STRONG))).select("doc_id", "text_hash", F.struct("start", "rank", "kind", "stop").alias("span"))
    rows = strong.unionByName(ends, allowMissingColumns=True)
    lists = rows.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("span")).alias("found"), F.array_sort(F.collect_list("link")).alias("links"))
    lists = materialize(lists.filter(F.size("found") > 0).select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "found", "links"))
    discard(found)
    return lists


def secret_scan(docs: DataFrame, scope: int = 400) -> DataFrame:
    """``docs`` (doc_id, text, more) to one row per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, linked, found, links.

    ``found`` is the array of (start, rank, kind, stop), ``spans`` the same as text, ``base_sha256`` the digest of the
    strong ones. ``links`` is the array of (secret, other), the secrets and the identifiers or endpoints at most
    ``scope`` code points off that are both reported, by the places of secret and other; ``linked`` is the same as text,
    ``secret>other`` joined by commas. A null text counts as empty and has no span: counts are 0, texts and arrays empty,
    and the digest is that of the empty string. A weak part that starts within a strong span is not reported. Rows that
    repeat doc_id and text get equal results; a null doc_id is a value like any other. Other columns of ``docs`` are not read.
    """
    lists = _reports(docs, scope)
    base = docs.select("doc_id", text_hash().alias("text_hash"))
    out = base.join(lists, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left")
    out = out.select("doc_id", *(F.coalesce(c, F.expr("array()").cast(lists.schema[c].dataType)).alias(c) for c in ("found", "links")))
    count = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    name = lambda s: F.concat_ws(":", s.kind, s.start, s.stop)
    joined = lambda spans: F.array_join(F.transform(spans, name), ",")
    strong = F.filter("found", lambda s: s.kind.isin(list(STRONG)))
    linked = F.array_join(F.transform("links", lambda x: F.concat_ws(">", name(x.secret), name(x.other))), ",")
    return out.select("doc_id", *[count(k) for k in STRONG], F.sha2(joined(strong), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), linked.alias("linked"), "found", "links")


def redact(docs: DataFrame, scope: int = 400, marker: str = "<secret>") -> DataFrame:
    """``docs`` with all its columns; each reported span of ``text`` is replaced by ``marker`` (spans that overlap or touch, by one). Texts without a span, null ones too, stay as they are."""
    lists = _reports(docs, scope).select("f_id", "f_hash", "found")
    rows = docs.select(F.struct("*").alias("doc"))
    text = text_of("doc.text")
    joined = rows.join(lists, F.col("doc.doc_id").eqNullSafe(F.col("f_id")) & (text_hash("doc.text") == F.col("f_hash")), "left")
    kept = F.expr("""
        aggregate(found, named_struct('at', 0L, 'out', array('')), (a, s) -> named_struct(
            'at', greatest(a.at, s.stop),
            'out', if(s.start <= a.at and a.at > 0, a.out, concat(a.out, array(substring(doc.text, int(a.at + 1), int(greatest(s.start - a.at, 0L))))))),
          a -> concat(slice(a.out, 2, size(a.out)), array(substring(doc.text, int(a.at + 1)))))
    """)
    redacted = F.when(F.col("found").isNull(), F.col("doc.text")).otherwise(F.array_join(kept, marker))
    return joined.select(F.col("doc").withField("text", redacted).alias("doc")).select("doc.*")
