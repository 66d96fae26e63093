"""Personal data: base patterns and bootstrapped contextual extraction (DataFrame functions only).

Base patterns find e-mail addresses, IP addresses, card and phone numbers. Around them
the method looks for more: tokens with digits or ``@`` are *instances* (of ``key=value`` the
value), and what stands beside them are lexical *patterns*: the word on the left (with the
one before it where it is only signs), the word on the right, and an assigning sign on the
left. Instances that a base pattern found are the seeds; those of ``secret``, a kind that
only the method has, are known key forms and long hexadecimal values that are assigned.

A pattern's confidence for a kind is its share of this kind among its distinct instances,
those that may still become it counting half; an instance's confidence is the noisy-or of
its patterns'. Both are computed in turns over the graph of distinct (pattern, instance)
edges. An unseen instance need only have the loose shape of a kind: digits in a band, an
``@`` between characters, letters and digits mixed; the patterns decide. Numbers that a card
or IP test rejects never become that kind. A sure instance is marked where one of the patterns
beside it is sure of the kind too; the same number in other surroundings stays unmarked.

The graph has one edge for equal occurrences, so copied documents don't add confidence and
a very common line is one edge. Patterns are summed by partial aggregation; those that are
sure enough are counted and go to the edges as a broadcast, beyond ``MAX_BROADCAST_KEYS`` by a
shuffle. Nothing is gathered per pattern or instance.

Defined cases: null text is the empty text and has no spans; matches that fail their test
are dropped and not retried; repeated rows each get their spans; kinds may overlap each
other; an added span never overlaps a base span; words of any length count whole; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.durable import durable
from lodestone.plans.keyed import MAX_BROADCAST_KEYS

KINDS = ("email", "ip", "card", "phone")
#: All kinds of spans, in order; the last has no base pattern.
FOUND_KINDS = (*KINDS, "secret")
#: Leftmost matches, per kind. Possessive where giving back can't help, and tried only at
#: the start of a run: both keep the time in proportion to the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: A token with a digit or ``@``; those without letters go together over single spaces.
_BARE = r"[^\x20\x09-\x0D0-9@\p{L}]*+[0-9@][^\x20\x09-\x0D\p{L}]*+(?![^\x20\x09-\x0D])"
INSTANCE = rf"(?<![^\x20\x09-\x0D])(?:{_BARE}(?:\x20{_BARE})*+|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
#: Spans are added up in blocks, so a text with very many costs little more for each.
BLOCK = 64
#: Rounds of scoring; a pattern counts from so many distinct instances and so much
#: confidence on, an instance from this confidence on.
ROUNDS, MIN_INSTANCES, MIN_PATTERN, MIN_INSTANCE = 3, 5, 0.6, 0.8
#: What an instance that may still become a kind weighs in its patterns.
OPEN = 0.5
#: A value that a name assigns: name and sign, quote, value.
ASSIGNED = r"^[(\[{<\"']*([\p{L}_-]{2,}[=:])[\"']?(?!//|[=:])(?=[^\x20]*[0-9@])(.+)$"
#: Fixed forms of access keys, and of assigned values that are seeds of secrets.
KEY_FORM, HEX_FORM = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$", r"^(?=[^\s]*[0-9])(?=[^\s]*[a-f])[0-9a-f]{32,}$"
#: What an unseen secret looks like: no spaces, letters and digits mixed.
SECRET_FORM = r"^(?=(?:[^0-9]*[0-9]){3})(?=(?:[^A-Za-z]*[A-Za-z]){3})[A-Za-z0-9+/_.~-]{12,200}$"
#: A token with ``@`` in an instance, without signs around it.
ADDRESS = r"(?<![\p{L}0-9])[\p{L}0-9][^\x20@]*+@[^\x20]*[\p{L}0-9]"
#: Digits of unseen instances: local phone numbers and short cards too.
PHONE_DIGITS, CARD_DIGITS, IP_DIGITS = (7, 15), (12, 19), (4, 12)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _located(text: Column, pattern: str, use) -> Column:
    """``use(found, pieces)`` of all matches and the pieces around them (one more than matches)."""
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    return _bound(cut, lambda x: use(x["found"], x["pieces"]))


def _starts(found: Column, pieces: Column) -> Column:
    """``(at, end, text)`` of each match, in code points.

    A fold copies what it has at each step, so lengths are summed by block first and each
    block is then folded from its own start.
    """
    lengths = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("p"), m.alias("m")))
    spans = F.array().cast("array<struct<at:int,end:int,text:string>>")

    def add(acc: Column, x: Column) -> Column:
        at = acc["to"] + x["p"]
        end = at + F.length(x["m"])
        span = F.struct(at.alias("at"), end.alias("end"), x["m"].alias("text"))
        return F.struct(end.alias("to"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def folded(ls: Column) -> Column:
        firsts = F.when(F.size(ls) > 0, F.sequence(F.lit(1), F.size(ls), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        sums = F.transform(firsts, lambda f: F.aggregate(F.slice(ls, f, BLOCK), F.lit(0), lambda acc, x: acc + x["p"] + F.length(x["m"])))
        zero = F.struct(F.lit(0).alias("to"), F.array().cast("array<int>").alias("all"))
        step = lambda acc, n: F.struct((acc["to"] + n).alias("to"), F.concat(acc["all"], F.array(acc["to"])).alias("all"))
        starts = F.aggregate(sums, zero, step, lambda acc: acc["all"])
        block = lambda f, to: F.aggregate(F.slice(ls, f, BLOCK), F.struct(to.alias("to"), spans.alias("spans")), add, lambda acc: acc["spans"])
        return F.flatten(F.zip_with(firsts, starts, block))

    return _bound(lengths, folded)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _parts_pass(parts: Column) -> Column:
    part = lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (part(p) <= 3) & (F.try_to_number(F.right(F.concat(F.lit("000"), p), F.lit(3)), F.lit("999")) <= 255))


def _passes(kind: str, text: Column) -> Column:
    digits = _digits(text)
    if kind == "ip":
        return _parts_pass(F.split(text, r"\."))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """``array<struct<at, end, text>>`` of one kind, failing matches left out."""
    spans = _located(text, PATTERNS[kind], lambda found, pieces: F.filter(_starts(found, pieces), lambda s: _passes(kind, s["text"])))
    empty = F.array().cast("array<struct<at:int,end:int,text:string>>")
    return F.when(text.rlike(NEEDS[kind]), spans).otherwise(empty)


def _instances(text: Column) -> Column:
    """``(at, end, text, left, right)`` of tokens with digits or ``@`` and the words beside them."""
    blanks = lambda piece: F.translate(piece, "\t\n\x0b\x0c\r", " " * 5)

    def beside(s: Column, around: Column) -> Column:
        before, after = F.rtrim(blanks(around["before"])), F.ltrim(blanks(around["after"]))
        last = F.substring_index(before, " ", -1)
        left = F.when(last.rlike(r"[\p{L}]"), last).otherwise(F.trim(F.substring_index(before, " ", -2)))
        return F.struct(
            s["at"].alias("at"), s["end"].alias("end"), s["text"].alias("text"),
            F.lower(left).alias("left"), F.lower(F.substring_index(after, " ", 1)).alias("right"),
        )

    def near(found: Column, pieces: Column) -> Column:
        around = F.zip_with(
            F.slice(pieces, 1, F.size(found)), F.slice(pieces, 2, F.size(found)), lambda p, q: F.struct(p.alias("before"), q.alias("after"))
        )
        return F.zip_with(_starts(found, pieces), around, beside)

    none = F.array().cast("array<struct<at:int,end:int,text:string,left:string,right:string>>")
    return F.when(text.rlike("[0-9@]"), _located(text, INSTANCE, near)).otherwise(none)


def _shapes(text: Column) -> Column:
    """Whether an unseen instance may become a kind, per kind."""
    digits = _digits(text)
    lettered = text.rlike(r"\p{L}")
    count, at = F.length(digits), F.contains(text, F.lit("@"))
    matches = lambda kind: F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    numbers = F.filter(matches("card"), lambda m: F.length(_digits(m)) >= 14)
    signs = F.length(F.regexp_replace(text, "[^.:]", ""))
    four = count.between(*IP_DIGITS) & (signs >= 3) & _parts_pass(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)))
    groups = text.rlike(r"^(?=.*::|(?:[^:]*:){7})[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}$")
    shapes = {
        "email": text.rlike(ADDRESS),
        "ip": ~at & (four | groups) & F.forall(matches("ip"), lambda m: _passes("ip", m)),
        "card": ~at & ~lettered & count.between(*CARD_DIGITS) & F.call_function("luhn_check", digits) & F.forall(numbers, lambda m: _passes("card", m)),
        "phone": ~at & ~lettered & count.between(*PHONE_DIGITS),
        "secret": text.rlike(SECRET_FORM),
    }
    return F.array(*[F.coalesce(shapes[k], F.lit(False)) for k in FOUND_KINDS])


#: Signs before an instance.
LEAD = r"^[^\p{L}0-9@+(]+"


def _bare(text: Column) -> Column:
    """An instance without punctuation around it."""
    return F.regexp_replace(text, LEAD + r"|[^\p{L}0-9)]+$", "")


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, id``, one array of base spans per kind, and ``near``, the instances of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    return durable(
        one.select("row", "id", *[base_spans(F.col("text"), k).alias(k) for k in KINDS], _instances(F.col("text")).alias("near")),
        "spans",
    )


def _spots(scanned: DataFrame) -> DataFrame:
    """``row, at, end, instance, left, right, kind``: instances and the kind of the base span on them, if any.

    Base spans and instances of a text are put in one order, so each looks at its
    neighbours only, however many there are.
    """
    one = scanned.select("row", F.explode("near").alias("n"))
    value = F.regexp_extract("n.text", ASSIGNED, 2)
    assigned = value != ""
    raw = F.when(assigned, value).otherwise(F.col("n.text"))
    one = one.select(
        "row", "n.end", raw.alias("raw"), "n.right",
        F.when(assigned, F.lower(F.regexp_extract("n.text", ASSIGNED, 1))).otherwise(F.col("n.left")).alias("left"),
    )
    bare = one.withColumn("instance", _bare(F.col("raw"))).where("instance <> ''")
    ahead = F.length("raw") - F.length(F.regexp_replace("raw", LEAD, ""))
    at = F.col("end") - F.length("raw") + ahead
    spots = bare.select("row", at.alias("at"), (at + F.length("instance")).alias("end"), "instance", "left", "right", F.lit(0).alias("rank"))
    based = scanned.select("row", F.explode(F.concat(*[F.transform(F.col(k), _ranked(i + 1)) for i, k in enumerate(KINDS)])).alias("b")).select(
        "row", "b.at", "b.end", *[F.lit(None).cast("string").alias(c) for c in ("instance", "left", "right")], "b.rank"
    )
    both = based.unionByName(spots)
    base = F.col("rank") > 0
    ahead_of = Window.partitionBy("row").orderBy("at", F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("row").orderBy(F.desc("at"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("open", F.max(F.when(base, F.struct("end", "rank"))).over(ahead_of)).withColumn(
        "next", F.min(F.when(base, F.struct("at", "rank"))).over(behind)
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    kind = F.when(F.col("open.end") > F.col("at"), F.element_at(names, F.col("open.rank"))).when(F.col("next.at") < F.col("end"), F.element_at(names, F.col("next.rank")))
    seed = F.col("instance").rlike(KEY_FORM) | F.col("instance").rlike(HEX_FORM) & F.col("left").rlike("[=:]$")
    return seen.where(~base).select("row", "at", "end", "instance", "left", "right", F.coalesce(kind, F.when(seed, F.lit("secret"))).alias("kind"))


def _beside(spots: DataFrame) -> DataFrame:
    """Each spot once for every ``pattern`` at its place."""
    side = lambda name, word: F.struct(F.lit(name).alias("side"), word.alias("word"))
    sides = F.array(side("left", F.col("left")), side("right", F.col("right")), side("sign", F.regexp_extract("left", "[=:]$", 0)))
    named = spots.select("*", F.explode(sides).alias("p")).where("p.word <> ''")
    return named.select("*", F.concat_ws(":", "p.side", "p.word").alias("pattern")).drop("p")


def _edges(spots: DataFrame) -> DataFrame:
    """``instance, pattern, kind`` per distinct pair; the kind is that of a seed."""
    return _beside(spots).groupBy("instance", "pattern").agg(F.max("kind").alias("kind"))


def _sure_patterns(edges: DataFrame, state: DataFrame) -> DataFrame:
    """``pattern, kind, confidence`` (``kind`` from 0) of patterns with many instances and enough confidence."""
    kinds = range(len(FOUND_KINDS))
    score, may = (lambda i: F.get("score", F.lit(i))), (lambda i: F.coalesce(F.get("may", F.lit(i)), F.lit(False)))
    summed = (
        edges.select("instance", "pattern").join(state, "instance", "left").groupBy("pattern")
        .agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(score(i), F.lit(0.0))).alias(f"got{i}") for i in kinds],
            *[F.sum(F.when(may(i), 1 - score(i)).otherwise(0.0)).alias(f"open{i}") for i in kinds],
        )
        .where(F.col("n") >= MIN_INSTANCES)
    )
    share = lambda i: F.round(F.col(f"got{i}") / (F.col("n") - OPEN * F.col(f"open{i}") + 1), 9)
    told = F.array(*[F.struct(F.lit(i).alias("kind"), share(i).alias("confidence")) for i in kinds])
    return summed.select("pattern", F.explode(told).alias("t")).select("pattern", "t.*").where(F.col("confidence") >= MIN_PATTERN)


def scores(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``instance, seeded, shape, may, score`` (arrays by kind) of all seeds and of instances with a kind's loose shape, and the patterns that gave them."""
    kinds = range(len(FOUND_KINDS))
    seeded = F.array(*[F.coalesce(F.max(F.col("kind") == k), F.lit(False)) for k in FOUND_KINDS])
    first = edges.groupBy("instance").agg(seeded.alias("seeded"), F.max(F.col("kind").isNull()).alias("unseen"))
    shaped = first.withColumn("shape", F.when(F.col("unseen"), _shapes(F.col("instance"))).otherwise(F.array_repeat(F.lit(False), len(kinds))))
    may = F.zip_with("shape", "seeded", lambda open_, known: open_ & ~known)
    state = durable(
        shaped.where(F.array_contains("seeded", True) | F.array_contains("shape", True))
        .select("instance", "seeded", "shape", may.alias("may"), F.transform("seeded", lambda x: x.cast("double")).alias("score")),
        "state",
    )
    live = durable(edges.select("instance", "pattern").join(state.where(F.array_contains("may", True)).select("instance"), "instance", "left_semi"), "live")
    for _ in range(rounds):
        patterns = durable(_sure_patterns(edges, state.select("instance", "may", "score")), "patterns")
        few = patterns.count() <= MAX_BROADCAST_KEYS
        found = (
            live.join(F.broadcast(patterns) if few else patterns, "pattern").groupBy(F.col("instance").alias("i"))
            .agg(F.array(*[F.sum(F.when(F.col("kind") == k, F.log(1 - F.col("confidence")))) for k in kinds]).alias("logs"))
        )
        new = F.transform("may", lambda open_, i: F.when(
            open_, F.round(1 - F.exp(F.coalesce(F.get("logs", i), F.lit(0.0))), 9)).otherwise(F.get("score", i)))
        state = durable(state.join(found, F.col("instance") == F.col("i"), "left").select("instance", "seeded", "shape", "may", new.alias("score")), "state")
    return state, patterns


def discover(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``row, rank, at, end`` of spans that no base pattern has: seeds of secrets, and instances that patterns give a kind."""
    spots = durable(_spots(scanned), "spots")
    judged, patterns = scores(durable(_edges(spots), "edges"), rounds)
    able = F.zip_with("shape", "score", lambda shape, score: F.when(shape, score).otherwise(0.0))
    sure = judged.select(F.col("instance").alias("i"), able.alias("able")).where(F.array_max("able") >= MIN_INSTANCE)
    likely = spots.where("kind is null").join(sure, F.col("instance") == F.col("i"))
    told = patterns.select(F.col("pattern").alias("q"), F.col("kind").alias("k"))
    few = told.count() <= MAX_BROADCAST_KEYS
    here = _beside(likely).join(F.broadcast(told) if few else told, F.col("pattern") == F.col("q")).where(F.get("able", F.col("k")) >= MIN_INSTANCE)
    best = F.max_by(F.col("k"), F.struct(F.get("able", F.col("k")), -F.col("k"))) + 1
    hits = here.groupBy("row", "at", "end", "instance").agg(best.cast("int").alias("rank")).select("row", "rank", "at", "end", "instance")
    known = spots.where("kind = 'secret'").select("row", F.lit(len(FOUND_KINDS)).alias("rank"), "at", "end", "instance")
    whole = F.array(F.struct(F.lit(0).alias("at"), F.length("instance").alias("end"), F.col("instance").alias("text")))
    # Numbers beside an address are not part of it.
    parts = F.when(F.col("rank") == 1, _located(F.col("instance"), ADDRESS, _starts)).otherwise(whole)
    return hits.unionByName(known).select("row", "rank", "at", F.explode(parts).alias("part")).select(
        "row", "rank", (F.col("at") + F.col("part.at")).alias("at"), (F.col("at") + F.col("part.end")).alias("end")
    )


def _joined(spans: Column) -> Column:
    """``kind:at:end`` by start, then kind as listed."""
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["at"].alias("at"), s["rank"].alias("rank"), s["end"].alias("end")))
    )
    names = F.array(*[F.lit(k) for k in FOUND_KINDS])
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["rank"]), s["at"].cast("string"), s["end"].cast("string"))), ","
    )


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, base spans per kind, ``base`` and ``spans`` as joined text, ``n_secret``, ``n_added``, ``n_found``.

    ``n_added`` counts the spans that the method adds, those of secrets among them, and
    ``n_found`` all spans.
    """
    scanned = scan(docs, id_col, text_col)
    added = (
        discover(scanned)
        .groupBy(F.col("row").alias("r"))
        .agg(F.collect_set(F.struct("at", "rank", "end")).alias("added"))
    )
    base = F.concat(*[F.transform(F.col(k), _ranked(i + 1)) for i, k in enumerate(KINDS)])
    none = F.array().cast("array<struct<at:int,rank:int,end:int>>")
    joined = scanned.join(added, F.col("row") == F.col("r"), "left").select(
        "row", "id", *KINDS, base.alias("b"), F.coalesce("added", none).alias("added")
    )
    secret = F.filter("added", lambda s: s["rank"] == len(FOUND_KINDS))
    return joined.select(
        F.col("id").alias(id_col), *KINDS, _joined(F.col("b")).alias("base"),
        _joined(F.concat("b", "added")).alias("spans"), F.size(secret).cast("long").alias("n_secret"),
        F.size("added").cast("long").alias("n_added"), (F.size("b") + F.size("added")).cast("long").alias("n_found"), "row",
    )


def _ranked(rank: int):
    return lambda s: F.named_struct(F.lit("at"), s["at"], F.lit("rank"), F.lit(rank), F.lit("end"), s["end"])
