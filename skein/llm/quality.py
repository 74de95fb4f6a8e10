"""Operator 6, quality rules, line first: lines that fail a rule go, then documents that lose too much text.

Native: DataFrame expressions only, no shuffle, one pass.
Nulls: a null text counts as no text (0 words, rejected, kept_text empty); other columns pass through untouched.
Lines of white space alone fail no rule and stay.  Empty text: 0 words, rejected.  Repeated rows are judged one by one and equally.  An empty table stays empty.
Very long texts are judged whole.  Ties: a share that meets its bound exactly passes.  Added columns that clash with a
column of the input replace it; no other column is touched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: [\x20\x09-\x0D], one by one: Java matches such a class by a table
WS = r" \t\n\x0B\f\r"
WORD = f"[^{WS}]"
#: Phrases of licence, copyright and notice lines, lower case; English, German, French, Spanish.
BOILERPLATE = [
    "all rights reserved", "licensed under", "released under the", "terms of service", "terms of use", "privacy policy",
    "cookie policy", "uses cookies", "click here", "subscribe to our newsletter", "enable javascript", "lorem ipsum",
    "alle rechte vorbehalten", "lizenziert unter", "nutzungsbedingungen", "datenschutzerklärung", "verwendet cookies",
    "klicken sie hier", "newsletter abonnieren", "javascript aktivieren",
    "tous droits réservés", "sous licence", "conditions d'utilisation", "politique de confidentialité", "utilise des cookies",
    "cliquez ici", "abonnez-vous à", "activer javascript",
    "todos los derechos reservados", "bajo licencia", "condiciones de uso", "política de privacidad", "utiliza cookies",
    "haga clic aquí", "suscríbete a", "habilitar javascript",
]


def bad_line(line: Column, separators_per_word: float = 0.25, symbols_per_word: float = 0.5, long_words: int = 12) -> Column:
    """True for a line that fails the navigation, symbol, boilerplate or punctuation rule.

    Navigation: three separators or more, and at least one to four words.  Symbols: at least one of #*$%&<>{} to two
    words.  Boilerplate: a phrase of BOILERPLATE in a line of up to 30 words.  Punctuation: a line of `long_words` words or more
    in which no word ends in punctuation at all.
    """
    words = F.regexp_count(line, F.lit(WORD + "+"))
    separators = F.regexp_count(line, F.lit("[|»›·•]"))
    symbols = F.regexp_count(line, F.lit("[#*$%&<>{}]+"))

    def phrase(lower: Column) -> Column:
        return reduce(lambda a, b: a | b, [lower.contains(p) for p in BOILERPLATE])

    unpunctuated = ~line.rlike(r"[^\x20\x09-\x0D][.!?…:;,。！？؟।](?:[\"'”’»)\]]*)(?:[\x20\x09-\x0D]|$)")
    # reads no further than the 31st word
    over_30 = line.rlike(f"^[{WS}]*+(?:{WORD}++[{WS}]++){{30}}{WORD}")
    # cheap tests first: the others run on few lines
    return (
        (
            line.rlike("[|»›·•#*$%&<>{}]")
            & (
                ((separators >= 3) & (separators >= words * separators_per_word))
                | ((symbols >= 2) & (symbols >= words * symbols_per_word))
            )
        )
        | (~over_30 & bind(F.lower(line), phrase))
        | (unpunctuated & (words >= long_words))
    )


def bind(column: Column, body) -> Column:
    """let column in body: evaluated once, by a lambda over a one-element array."""
    return F.get(F.transform(F.array(column), body), F.lit(0))


def repeated_words(words: Column, width: int = 5) -> Column:
    """Number of words that lie in a window of `width` words found twice or more in the array.

    Windows are compared by a 64-bit hash; texts without repeats stop after one hash set.  In others, windows are first
    sorted by the hash without the bits of a position, which may only find too many; the whole hash decides on those.
    """
    shifted = [words] + [F.slice(words, k + 1, F.size(words)) for k in range(1, width)]
    zipped = F.transform(F.arrays_zip(*shifted), lambda w: F.xxhash64(w))
    hashes = F.slice(zipped, 1, F.size(words) - F.lit(width - 1))

    def covered(h: Column) -> Column:
        # hash and start in one long, the start in as many low bits as it needs, so that plain longs are sorted
        n = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(h).cast("long")))) - 1

        def starts(packed: Column, low: Column) -> Column:
            def same(a: Column, b: Column) -> Column:
                return a.bitwiseXOR(b).between(F.lit(0).cast("long"), low)

            hit = F.filter(packed, lambda x, k: same(x, F.get(packed, k - 1)) | same(x, F.get(packed, k + 1)))
            return F.sort_array(F.transform(hit, lambda x: x.bitwiseAND(low).cast("int")))

        def packed(low: Column) -> Column:
            return F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))

        return bind(n, lambda low: bind(packed(low), lambda p: starts(p, low)))

    def equal(at: Column, h: Column) -> Column:
        def neighbours(pairs: Column) -> Column:
            def same(x: Column, k: Column) -> Column:
                return F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(pairs, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        return bind(F.sort_array(F.transform(at, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i")))), neighbours)

    def total(at: Column) -> Column:
        n = F.size(at)
        steps = F.transform(
            at, lambda x, k: F.when(k + 1 < n, F.least(F.lit(width), F.get(at, k + 1) - x)).otherwise(F.lit(width))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    return F.when(F.size(words) < width, F.lit(0).cast("long")).otherwise(
        bind(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
                bind(bind(covered(h), lambda at: equal(at, h)), total)
            ),
        )
    )


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    min_kept_percent: int = 50,
) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bad_lines, kept_word_chars,
    kept_text, base_failed and kept.

    kept_text: the lines that pass every rule, in their order.
    base_failed: fewer than min_words words, or more than max_repeat_percent of the words in repeated 5-word windows.
    kept: not base_failed, and the lines that pass every rule hold at least min_kept_percent of the word characters.
    """
    new = "_quality"
    while any(c.lower().startswith(new) for c in docs.columns):
        new += "_"
    w_, all_, lines_, m_ = (new + x for x in ("words", "all", "lines", "m"))
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, f"[{WS}]+"), "")
    out = docs.withColumns({w_: words, all_: F.split(body, "\n")})
    out = out.withColumn(lines_, F.filter(all_, lambda x: x.rlike(WORD)))
    good = bind(
        F.filter(all_, lambda x: ~bad_line(x)),
        lambda g: bind(
            F.array_join(g, "\n"),
            lambda kept: F.struct(
                (F.size(all_) - F.size(g)).cast("long").alias("n_bad_lines"),
                F.length(F.regexp_replace(kept, f"[{WS}]+", "")).cast("long").alias("kept_word_chars"),
                kept.alias("kept_text"),
            ),
        ),
    )
    counts = F.struct(
        F.size(w_).cast("long").alias("n_words"),
        F.length(F.array_join(w_, "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(w_)).alias("n_repeat_words"),
        good.alias("good"),
    )
    # a generator of one row: filters on the counts are not pushed below it, which would repeat the work for each
    out = out.withColumn(m_, F.explode(F.array(counts)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = out.withColumns({n: F.col(f"{m_}.{n}") for n in names} | {n: F.col(f"{m_}.good.{n}") for n in ("n_bad_lines", "kept_word_chars", "kept_text")})
    out = out.withColumn(
        "base_failed",
        (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
    )
    return out.withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("kept_word_chars") >= min_kept_percent * F.col("word_chars"))
    ).drop(w_, all_, lines_, m_)
