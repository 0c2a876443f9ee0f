"""Secret scans with a random forest that removes false positives.

Everything is a DataFrame expression. A text is cut into words with their trailing white space, and
each word into pieces: values of credential keys (any symbols), values of other keys, passwords
in addresses, and bare runs. Every piece that may hold a credential becomes a
candidate with its offset, its assignment key and the neighbouring words. A random forest
over ``FEATURES`` is trained with the DataFrame ML API on labelled findings, its trees are
walked by one SQL expression, and that expression scores the candidates inside the row's own
array: no shuffle, no join, no Python worker, and texts without digits, ``=``, ``:``, known forms or credential keys are never cut at all.

Labelled findings are a table (word, before, after, label) of any origin. ``synthetic_findings`` makes a
bounded set of typical ones where no reviewed findings are at hand.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import save, workspace

#: Bound of the labelled findings that training reads, and of the forest.
MOST_TRAINED = 6000
TREES, DEPTH, SEED = 20, 6, 17
SECRET = 0.5
MASK = "[SECRET]"
#: Words whose lengths are summed at once.
STRETCH = 256

KEYS = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|bearer|credential|private[_-]?key|client[_-]?secret"
BENIGN = r"sha\d*|md5|checksum|digest|commit|revision|uuid|guid|build|version|isbn|serial|order|invoice|etag|hash|card|phone|tel"
KNOWN = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_|^sk_(?:live|test)_|^xox[abprs]-|^AIza|^glpat-|^eyJ"
WORDS = "about account action archive article backup branch build cache channel chapter client cluster code color config content control count customer data default delete design device document draft event example export feature file filter final format frame function group header history home image import index input item label library license line list local main manager master message method model module monday network node note number object option order output package page path photo place plan plugin point print process product project public query range record region release report request response result review sample schema screen script section series server service session simple size source stage standard start state static status string style summary system table target template test theme thread time title tool total train update upload user value version video view week window work world write year".split()

#: Known forms anywhere in a word, before it is cut.
_KNOWN = r"AKIA|ASIA|gh[pousr]_|sk_(?:live|test)_|xox[abprs]-|AIza|glpat-|eyJ"
_NAME = r"[A-Za-z0-9_.\-]"
_ASSIGN = r"""\\?["'`]?[\])]?(?:[:=]+>?|>)\\?["'`]?"""
#: A value in quotes up to the next quote, or one without up to a separator before another pair, a closing tag or closing punctuation.
_WIDE = rf"""(?:(?<=["'`])[^\s"'`]{{4,}}(?<!\\)|(?=[^\s"'`<][^\s"'`<]{{3}}|[^\s"'`<]{{1,3}}[<'][^\s"'`/])[^\s"'`;&,|<]*(?:(?:[;&,|<](?!\s*$|["'{{\[(]|/[A-Za-z]|{_NAME}{{1,40}}\\?["']?[:=])|'(?=[A-Za-z0-9]))[^\s"'`;&,|<]*){{0,500}}(?<![.,;:?!)\]}}>#*]))"""
_BARE = r"[A-Za-z0-9_/+.\-]{7,}[A-Za-z0-9_/+\-]={0,2}"
_USER = r"""://(?:[^\s/:@"'<>]{0,100}:)?[^\s/"'<>]{4,}(?=@)"""
_PIECE = "|".join((
    rf"(?<!{_NAME}){_NAME}{{0,40}}(?i:{KEYS}){_NAME}{{0,40}}{_ASSIGN}{_WIDE}",
    _USER,
    rf"""(?<!{_NAME})[A-Za-z]{_NAME}{{0,40}}{_ASSIGN}(?!//[^\s/@]*@){_BARE}""",
    _BARE,
    r"[^A-Za-z0-9_/+.\-:]+|(?s:.)",
))
#: The same for a word behind ``key =``: what it begins with is the value.
_GIVEN = rf"""(?<=^["'`]{{0,2}}){_WIDE}|{_PIECE}"""
#: The end of the words before, where they assign to a credential key.
_BEFORE = rf"""(?i)(?:{KEYS}){_NAME}*\\?["'`]?[\])]?\s*[:=]+>?$"""
FEATURES = ("length", "transitions", "digits", "upper", "letters_run", "hex", "pairs", "distinct", "dictionary", "slashes", "path_word", "key", "near_key", "near_benign", "assigned", "known", "groups", "symbols")


def _len(c: Column) -> Column:
    return F.length(c).cast("double")


def _share(value: Column, removed: str) -> Column:
    return (F.length(value) - F.length(F.regexp_replace(value, removed, ""))) / F.greatest(_len(value), F.lit(1.0))


def features(word: Column, key: Column, value: Column, before: Column, after: Column) -> list[Column]:
    """Doubles in the order of FEATURES."""
    classes = F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "A" * 26 + "a" * 26 + "9" * 10)
    runs = F.regexp_replace(classes, r"(.)\1+", "$1")
    low = F.lower(value)
    context = F.lower(F.concat_ws(" ", before, key))
    return [
        F.least(_len(value), F.lit(200.0)),
        (_len(runs) - 1) / F.greatest(_len(value), F.lit(1.0)),
        _share(value, "[0-9]"),
        _share(value, "[A-Z]"),
        F.array_max(F.transform(F.split(value, "[^A-Za-z]+"), lambda x: F.length(x))).cast("double"),
        value.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
        (_len(low) - _len(F.regexp_replace(low, "[bcdfghjklmnpqrstvwxz][aeiouy]", "."))) / F.greatest(_len(value), F.lit(1.0)),
        F.size(F.array_distinct(F.split(value, ""))) / F.greatest(F.least(_len(value), F.lit(36.0)), F.lit(1.0)),
        _share(low, "|".join(WORDS)),
        _len(F.regexp_replace(value, "[^/]", "")),
        word.rlike(r"://|@|^[./~]|[/\\].*[/\\]|\.[A-Za-z]{2,5}[)\"',.;]*\s*$").cast("double"),
        _credential(key).cast("double"),
        context.rlike(KEYS).cast("double"),
        F.lower(F.concat_ws(" ", before, key, after)).rlike(rf"(?:^|[^a-z])(?:{BENIGN})(?:[^a-z]|$)").cast("double"),
        ((F.length(key) > 0) | F.trim(before).rlike("[=:]$")).cast("double"),
        value.rlike(KNOWN).cast("double"),
        value.rlike(r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-|^[0-9.\-/+]+$|^v?\d+(\.\d+)+").cast("double"),
        _share(value, r"[^A-Za-z0-9_/+.\-=]"),
    ]


def _credential(key: Column) -> Column:
    return key.rlike(f"(?i)({KEYS})") | (key == "://")


def is_candidate(word: Column, key: Column, value: Column, before: Column | None = None) -> Column:
    """A value of 12 characters with a digit, of a known form, or of a credential key in the same word or the words ``before`` it."""
    near = F.lit(False) if before is None else before.rlike(_BEFORE) | ((F.length(value) >= 8) & before.rlike(f"(?i){KEYS}"))
    return ((F.length(value) >= 12) & value.rlike("[0-9]")) | value.rlike(KNOWN) | ((F.length(value) >= 4) & (_credential(key) | near))


def _found(word: Column, before: Column) -> Column:
    """array<struct(o, key, value, near)>: the candidates of a word with the value's offset; ``near`` is its piece with what touches it."""
    given = before.rlike(_BEFORE)
    pieces = F.when(given, F.regexp_extract_all(word, F.lit(_GIVEN), F.lit(0))).otherwise(F.regexp_extract_all(word, F.lit(_PIECE), F.lit(0)))

    def split(p: Column, o: Column) -> Column:
        whole = given & (o <= 2)
        key = F.when(whole, "").when(p.startswith("://"), "://").otherwise(F.regexp_extract(p, rf"^({_NAME}+){_ASSIGN}[^:=]", 1))
        tail = F.when(whole, p).when(p.startswith("://"), F.regexp_extract(p, r"""(?s)^://(?:[^\s/:@"'<>]*:)?(.*)$""", 1)).when(key != "", F.regexp_extract(p, rf"(?s)^{_NAME}+{_ASSIGN}([^:=].*)$", 1)).otherwise(p)
        return F.struct((o + F.length(p) - F.length(tail)).alias("o"), key.alias("key"), tail.alias("value"), F.substring(word, F.greatest(o - 2, F.lit(1)), F.length(p) + 4).alias("near"))

    none = F.array().cast("array<struct<o:int,key:string,value:string,near:string>>")

    def step(acc: Column, p: Column) -> Column:
        ok = lambda s: is_candidate(word, s["key"], s["value"], before)
        more = F.when((F.length(p) >= 4) & p.rlike("[A-Za-z0-9]"), F.filter(F.array(split(p, acc["o"])), ok)).otherwise(none)
        return F.struct((acc["o"] + F.length(p)).alias("o"), F.concat(acc["out"], more).alias("out"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("o"), none.alias("out")), step, lambda acc: acc["out"])


def parts(word: Column) -> tuple[Column, Column]:
    """(key, value) of a word's first candidate; both empty if it has none."""
    first = F.get(_found(word, F.lit("")), 0)
    return F.coalesce(first["key"], F.lit("")), F.coalesce(first["value"], F.lit(""))


def synthetic_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(word, before, after, label): ``n`` typical findings, half of them secrets, from hashes of the row number.

    The cases are data: lists of pieces in a literal array, which one expression spells out. The plan does not grow with them; as
    nested conditions they were more code than a class can hold, and compiling it in vain took the driver's memory.
    """
    lists: list[list[str]] = []

    def pick(seed: str, xs) -> dict:
        if (xs := list(xs)) not in lists:
            lists.append(xs)
        return {"kind": "pick", "seed": seed, "of": lists.index(xs)}

    num = lambda seed, n, least=0: {"kind": "num", "seed": seed, "n": n, "least": least}
    hexa, b64, plain, upper, letters = ((lambda seed, n, kind=kind: {"kind": kind, "seed": seed, "n": n}) for kind in ("hex", "b64", "plain", "upper", "letters"))
    prose = ("the", "of", "and", "with", "from", "when", "stine", "morel", "we", "for", "see", "der", "una", "les", "tionha", "is", "to", "on")
    key = pick("k", ("password", "passwd", "secret", "api_key", "token", "auth", "pwd", "access_key", "client_secret"))
    quote = pick("q", ("", '"', "'"))
    w1, w2 = pick("w1", WORDS), pick("w2", WORDS)
    (title1, title2), (upper1, upper2) = ([pick(s, map(f, WORDS)) for s in ("w1", "w2")] for f in (str.capitalize, str.upper))
    leet1 = pick("w1", (w.translate(str.maketrans("ae", "40")) for w in WORDS))
    sign, sign2 = pick("s1", tuple("!@#$%&*;,")), pick("s2", tuple("!@$%*^~"))
    good = [
        (["AKIA", upper("a", 16)], pick("b", prose)),
        (["AKIA", upper("a", 16)], pick("b", ("key", "id", "aws", "access", "="))),
        ([key, "=", quote, hexa("v", 18), quote], pick("b", prose)),
        ([key, "=", quote, b64("v", 24), quote], pick("b", prose)),
        (['"', hexa("v", 40), '"'], [key, " ="]),
        ([quote, b64("v", 32), quote], [key, ":"]),
        (["ghp_", plain("v", 44)], pick("b", prose)),
        (["sk_live_", plain("v", 24)], pick("b", ("stripe", "key", "of", "with"))),
        ([key, ":", hexa("v", 32)], pick("b", prose)),
        ([key, "=", quote, title1, sign, num("n", 900), sign2, hexa("v", 5), quote], pick("b", prose)),
        ([quote, title1, sign, num("n", 900), sign2, hexa("v", 5), quote], [key, pick("e", (" =", ":"))]),
        ([key, "=", leet1, sign, w2, num("n", 900)], pick("b", prose)),
        ([key, pick("e", ("=", ":")), w1, num("n", 990, 10), pick("f", ("x", "", "q"))], pick("b", prose)),
        ([quote, w1, num("n", 990, 10), pick("f", ("x", "", "q")), quote], [key, pick("e", (" =", ":"))]),
        ([pick("e", ("oauth2_token", "s3_secret", "2fa_token", "db1.password")), "=", hexa("v", 20)], pick("b", prose)),
        ([pick("e", ("postgres", "mysql", "redis", "amqp", "https")), "://", w1, ":", title2, hexa("v", 6), "@db.local:5432/app"], pick("b", prose)),
        (["https://", w1, ".example.com/?", key, "=", hexa("v", 20), "&x=1"], pick("b", prose)),
        (["AKIA", letters("a", 16)], pick("b", prose)),
        (['{"user":"', w1, '","', key, '":"', hexa("v", 20), '"}'], pick("b", prose)),
        (b64("v", 40), [pick("b", ("secret", "aws_secret", "bearer", "credential")), pick("e", (" =", ":", ""))]),
    ]
    bad = [
        (hexa("v", 40), pick("b", ("commit", "revision", "sha1", "merge commit"))),
        (hexa("v", 32), pick("b", ("md5", "checksum", "etag", "hash"))),
        (["sha256:", hexa("v", 64)], pick("b", ("digest", "image", "of"))),
        ([hexa("u", 8), "-", hexa("v", 4), "-", hexa("w", 4), "-", hexa("x", 4), "-", hexa("y", 12)], pick("b", ("uuid", "id", "request", "the", "session"))),
        (["/", w1, "/", w2, "/", pick("w3", WORDS), num("n", 900), ".txt"], pick("b", prose)),
        ([w1, "_", w2, "_", num("n", 9000)], pick("b", prose)),
        (["https://", w1, ".example.com/", w2, "/", num("n", 99999)], pick("b", prose)),
        ([num("n", 9000, 1000), num("m", 9000, 1000), num("o", 9000, 1000), num("p", 9000, 1000)], pick("b", (*prose, "card"))),
        ([pick("w3", ("version", "release", "build")), "-", num("n", 30), ".", num("m", 30), ".", num("o", 3000), "-", w1], pick("b", prose)),
        ([w1, w2, num("n", 3000)], pick("b", prose)),
        (["2024-0", num("n", 9, 1), "-1", num("m", 9), "T10:2", num("o", 9), ":00"], pick("b", prose)),
        ([key, "=", pick("w3", ("changeme", "required", "optional", "disabled", "yourpassword", "undefined"))], pick("b", prose)),
        ([w1, w2], [key, pick("e", ("", " of", " for", " is"))]),
        ([w1, pick("e", ("", ",", "."))], [key, pick("f", (":", " ="))]),
        ([key, pick("e", ("=", ":")), pick("f", ("", "$", "self.", "get_")), w1, pick("g", ("", "()", "_", ".")), w2], pick("b", prose)),
        ([key, pick("e", ("=${", "={", "=%(")), w1, pick("g", ("", "_", ".")), w2, "}"], pick("b", prose)),
        ([key, pick("e", ("=${", "=$", "=")), upper1, pick("g", ("_", "_", ".")), upper2, "}"], pick("b", prose)),
        (pick("e", ("Bearer", "Basic", "Digest", "None", "null", "true", "false")), [key, pick("f", (":", " ="))]),
        ([w1, ".", w2, num("n", 9000, 1000), "@example.com"], pick("b", (*prose, "mail"))),
        ([pick("e", ("ssh", "git", "https")), "://", w1, "@", w2, ".example.com/x.git"], pick("b", prose)),
        (["http://", w1, ".local:8080/", w2, "/", pick("w3", WORDS), num("n", 9000)], pick("b", prose)),
        (["+1-555-", num("n", 900, 100), "-", num("m", 9000, 1000)], pick("b", (*prose, "phone", "tel"))),
    ]
    after = pick("z", prose)
    pieces = lambda x: [{"kind": "text", "text": p} if isinstance(p, str) else p for p in (x if isinstance(x, list) else [x])]
    piece = "array<struct<kind:string,seed:string,n:int,least:int,of:int,text:string>>"
    cases = F.from_json(F.lit(json.dumps([[pieces(w), pieces(b), pieces(after)] for w, b in good + bad])), f"array<array<{piece}>>")
    choices = F.from_json(F.lit(json.dumps(lists)), "array<array<string>>")

    def spelled(p: Column) -> Column:
        h = lambda s: F.sha2(F.concat_ws("|", s, F.col("id").cast("string")).cast("binary"), 256)
        at = lambda m: (F.conv(F.substring(h(p["seed"]), 1, 7), 16, 10).cast("long") % m).cast("int")
        two = F.concat(h(p["seed"]), h(F.concat(p["seed"], F.lit("+"))))
        text = F.regexp_replace(F.base64(F.unhex(two)), r"\s", "")
        first = lambda s: F.substring(s, F.lit(1), p["n"])
        capital = F.translate(F.upper(first(F.regexp_replace(text, "[/+=]", ""))), "0189", "2345")
        of = F.get(choices, p["of"])
        spell = {"text": p["text"], "pick": F.get(of, at(F.size(of))), "num": (at(p["n"]) + p["least"]).cast("string"), "hex": first(two), "b64": first(text), "plain": F.translate(first(text), "/+=", "xxx"), "upper": capital, "letters": F.translate(capital, "2345", "KWQZ")}
        return F.coalesce(*[F.when(p["kind"] == kind, x) for kind, x in spell.items()])

    label, kind = (F.col("id") % 2).cast("int"), F.floor(F.col("id") / 2).cast("int")
    case = F.get(cases, F.when(label == 1, kind % len(good)).otherwise(len(good) + kind % len(bad)))
    words = F.transform(case, lambda ps: F.array_join(F.transform(ps, spelled), ""))
    found = spark.range(n).select(words.alias("x"), label.alias("label"))
    return found.select(*[F.get("x", i).alias(name) for i, name in enumerate(("word", "before", "after"))], "label")


def train(findings: DataFrame) -> list:
    """Decision trees from labelled findings (word, before, after, label), at most ``MOST_TRAINED / 2`` of each label, chosen by a hash; rows without a candidate word don't count.

    Without both labels a single leaf.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    findings = save(findings.select("word", "before", "after", "label"), f"{workspace(findings.sparkSession, 'findings')}/table")
    f = findings.select("word", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), F.col("label").cast("double").alias("label")).filter("word IS NOT NULL AND label IN (0, 1)")
    chosen = F.xxhash64("word", "before", "after")
    f = f.filter("label = 1").orderBy(chosen, "word").limit(MOST_TRAINED // 2).union(f.filter("label = 0").orderBy(chosen, "word").limit(MOST_TRAINED // 2))
    f = f.withColumn("c", F.get(_found(F.col("word"), F.col("before")), 0)).filter("c IS NOT NULL")
    f = f.select("before", "after", "label", "c.near", "c.key", "c.value")
    cols = features(F.col("near"), F.col("key"), F.col("value"), F.col("before"), F.col("after"))
    f = f.select("label", *[c.alias(n) for c, n in zip(cols, FEATURES, strict=True)]).coalesce(1)
    seen = [r.label for r in f.select("label").distinct().collect()]
    if len(seen) < 2:
        return [seen[0] if seen else 0.0]
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(f)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(ready)
    return [parse(t.toDebugString) for t in model.trees]


def parse(text: str) -> list | float:
    """A tree's description -> (feature, threshold, left, right) or the predicted label."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]

    def node() -> list | float:
        line = lines.pop(0)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        left = node()
        lines.pop(0)
        return [int(m[1]), float(m[2]), left, node()]

    return node()


def forest(trees: list, x: Column) -> Column:
    """The share of trees that vote 1, over an array of features.

    Trees are laid out as complete ones in three literal arrays, node n above nodes 2n and 2n + 1, and walked by the expression, so the
    plan does not grow with them.
    """

    def depth(t) -> int:
        return 0 if isinstance(t, float) else 1 + max(depth(t[2]), depth(t[3]))

    deep = max(1, *map(depth, trees))
    n = 1 << deep
    feature, limit, leaf = ([v] * (n * len(trees)) for v in (0, float("inf"), 0.0))

    def lay(k: int, node: int, t) -> None:
        if node >= n:
            leaf[k * n + node - n] = t
            return
        if not isinstance(t, float):
            feature[k * n + node], limit[k * n + node] = t[0], t[1]
        for i in (0, 1):
            lay(k, 2 * node + i, t if isinstance(t, float) else t[2 + i])

    for k, t in enumerate(trees):
        lay(k, 1, t)
    text = lambda values, kind: F.split(F.lit(" ".join("Infinity" if v == float("inf") else repr(v) for v in values)), " ").cast(f"array<{kind}>")
    f, m, leaves = text(feature, "int"), text(limit, "double"), text(leaf, "double")

    def vote(k: Column) -> Column:
        right = lambda node: F.when(F.get(x, F.get(f, k * n + node)) > F.get(m, k * n + node), 1).otherwise(0)
        end = F.aggregate(F.sequence(F.lit(1), F.lit(deep)), F.lit(1), lambda node, _: node * 2 + right(node))
        return F.get(leaves, k * n + end - n)

    total = F.aggregate(F.sequence(F.lit(0), F.lit(len(trees) - 1)), F.lit(0.0), lambda sum_, k: sum_ + vote(k))
    return total / F.lit(float(len(trees)))


def _size(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))


def _ends(words: Column) -> Column:
    """Code points before each stretch of ``STRETCH`` words."""
    stretches = F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / F.lit(STRETCH)).cast("int")), lambda b: _size(F.slice(words, b * STRETCH + 1, STRETCH)))
    return F.aggregate(stretches, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def _offset(words: Column, ends: Column, i: Column) -> Column:
    """Code points before word ``i``; no more than a stretch is looked at."""
    b = F.floor(i / F.lit(STRETCH)).cast("int")
    return F.get(ends, b) + _size(F.slice(words, b * STRETCH + 1, i - b * STRETCH))


def _candidates(words: Column, ends: Column, keys: Column) -> Column:
    """array<struct(start, key, value, near, before, after)> over the words of a text; ``keys`` says that it names a credential at all."""
    at = lambda i: F.coalesce(F.trim(F.regexp_replace(F.get(words, i), r"\s+$", "")), F.lit(""))
    keyed = lambda i: F.coalesce(F.get(words, i).rlike(f"(?i){KEYS}"), F.lit(False))
    looks = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda s: (F.length(s["word"]) >= 4) & (s["word"].rlike(rf"[0-9=:>]|{_KNOWN}") | (keys & (keyed(s["i"] - 1) | keyed(s["i"] - 2)))))
    near = F.transform(looks, lambda s: F.struct(s["i"].alias("i"), s["word"].alias("word"), F.trim(F.concat_ws(" ", at(s["i"] - 2), at(s["i"] - 1))).alias("before")))
    cut = F.filter(F.transform(near, lambda s: F.struct(s["i"].alias("i"), s["before"].alias("before"), _found(s["word"], s["before"]).alias("found"))), lambda s: F.size(s["found"]) > 0)
    return F.flatten(F.transform(cut, lambda s: F.transform(s["found"], lambda c: F.struct((_offset(words, ends, s["i"]) + c["o"]).alias("start"), c["key"].alias("key"), c["value"].alias("value"), c["near"].alias("near"), s["before"].alias("before"), at(s["i"] + 1).alias("after")))))


def _scored(docs: DataFrame, trees: list, text: str) -> DataFrame:
    """``docs`` with ``_found``: its candidates with their probability."""
    d = docs.withColumn("_keys", F.col(text).rlike(f"(?i){KEYS}"))
    words = F.when(F.col("_keys") | F.col(text).rlike(f"[0-9=:>]|{_KNOWN}"), F.split(text, r"(?<=\s)(?=\S)"))
    # Behind lambdas the words are cut and measured once, wherever the optimizer copies the expression to.
    measured = F.transform(F.array(words), lambda ws: F.struct(ws.alias("w"), _ends(ws).alias("e")))
    d = d.withColumn("_c", F.flatten(F.transform(measured, lambda m: _candidates(m["w"], m["e"], F.col("_keys")))))
    d = d.withColumn("_f", F.transform("_c", lambda s: F.array(*features(s["near"], s["key"], s["value"], s["before"], s["after"]))))
    p = F.transform("_f", lambda x: forest(trees, x))
    return d.withColumn("_found", F.arrays_zip(F.col("_c").alias("c"), p.alias("p"))).drop("_keys", "_c", "_f")


def scan(docs: DataFrame, findings: DataFrame | list | None = None, text: str = "text") -> DataFrame:
    """(doc_id, start, end, key, value_sha256, probability, secret), one row for each candidate of ``docs`` (doc_id, text, any others).

    ``start`` and ``end`` are code point offsets of the value; the value itself is given as a digest only.
    ``findings`` are labelled findings or the trees that ``train`` made of some. ``secret`` is probability >= 0.5. Null and empty texts have no candidates; repeated rows repeat their candidates; an empty table
    gives an empty result. Other columns are ignored.
    """
    trees = findings if isinstance(findings, list) else train(findings if findings is not None else synthetic_findings(docs.sparkSession))
    d = docs.select("doc_id", F.col(text).alias("text"))
    # Not a plain explode: the filter that it implies would work out all candidates twice.
    found = _scored(d, trees, "text").select("doc_id", F.explode_outer("_found").alias("s")).filter("s IS NOT NULL")
    c = F.col("s.c")
    start = c["start"].cast("long")
    return found.select("doc_id", start.alias("start"), (start + F.length(c["value"])).alias("end"), c["key"].alias("key"), F.sha2(c["value"].cast("binary"), 256).alias("value_sha256"), F.col("s.p").alias("probability"), (F.col("s.p") >= SECRET).alias("secret"))


def redact(docs: DataFrame, findings: DataFrame | list | None = None) -> DataFrame:
    """``docs`` (text, any others) with every secret value replaced by ``MASK``, all rows and columns kept.

    ``n_chars``, where there is one, follows the new text.
    """
    trees = findings if isinstance(findings, list) else train(findings if findings is not None else synthetic_findings(docs.sparkSession))
    d = _scored(docs.select("text", F.struct(*docs.columns).alias("row")), trees, "text")
    bad = F.filter("_found", lambda s: s["p"] >= SECRET)
    d = d.withColumn("_bad", F.transform(bad, lambda s: F.struct(s["c"]["start"].alias("start"), F.length(s["c"]["value"]).alias("n"))))
    behind = lambda i: F.coalesce(F.get("_bad", i - 1)["start"] + F.get("_bad", i - 1)["n"], F.lit(0))
    kept = F.transform("_bad", lambda s, i: F.concat(F.substring("text", behind(i) + 1, s["start"] - behind(i)), F.lit(MASK)))
    masked = F.concat(F.array_join(kept, ""), F.substring("text", behind(F.size("_bad")) + 1, F.length("text")))
    d = d.withColumn("text", F.when(F.size("_bad") > 0, masked).otherwise(F.col("text")))
    row = F.col("row")
    new = {"text": F.col("text"), "n_chars": F.when(F.size("_bad") > 0, F.length("text").cast("long")).otherwise(row["n_chars"]) if "n_chars" in docs.columns else None}
    return d.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
