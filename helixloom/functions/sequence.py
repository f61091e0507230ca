"""Column functions over sequences; all run inside the JVM.

Coordinates are 1-based and inclusive unless a name says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Recognition sites, complement letters and codons.
BUILD_SITES = {"EcoRI": "GAATTC", "XbaI": "TCTAGA", "SpeI": "ACTAGT", "PstI": "CTGCAG", "NdeI": "CATATG", "BsaI": "GGTCTC", "BbsI": "GAAGAC"}
TYPE_IIS_SITES = {"BsmBI": "CGTCTC", "BsaI": "GGTCTC", "SapI": "GCTCTTC"}
SIX_CUTTERS = {"NcoI": "CCATGG", "EcoRI": "GAATTC", "XbaI": "TCTAGA", "SpeI": "ACTAGT", "PstI": "CTGCAG"}
BASES, PAIRED = "ACGTNacgtn", "TGCANtgcan"
IUPAC, IUPAC_PAIRED = "ACGTRYKMSWBDHVNacgtrykmswbdhvn", "TGCAYRMKSWVHDBNtgcayrmkswvhdbn"
CODON_ORDER = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOPS = ("TAA", "TAG", "TGA")
STARTS = ("ATG", "GTG", "TTG")
SHINE_DALGARNO = "AGGAGG"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revcomp(seq: Column | str) -> Column:
    """Reverse complement of A, C, G, T, N in either case; others stay."""
    return F.reverse(F.translate(col(seq), BASES, PAIRED))


def iupac_revcomp(seq: Column | str) -> Column:
    return F.reverse(F.translate(col(seq), IUPAC, IUPAC_PAIRED))


def normalise(seq: Column | str) -> Column:
    """Upper-case letters alone."""
    return F.regexp_replace(F.upper(col(seq)), r"[^\p{L}]", "")


def valid_alphabet(seq: Column | str) -> Column:
    return col(seq).rlike("^[ACGTNRYKMSWBDHV]*$")


def count_of(seq: Column | str, letters: str) -> Column:
    """How many of ``letters`` there are; each is taken out in turn, which
    is many times faster than a translation letter by letter."""
    rest = col(seq)
    for letter in letters:
        rest = F.replace(rest, F.lit(letter), F.lit(""))
    return F.length(col(seq)) - F.length(rest)


def gc_fraction(seq: Column | str) -> Column:
    """Share of G and C, 0 for an empty sequence."""
    n = F.length(col(seq))
    return F.when(n == 0, F.lit(0.0)).otherwise(count_of(F.upper(col(seq)), "GC") / n)


def gc_percent(seq: Column | str) -> Column:
    return 100.0 * gc_fraction(seq)


def longest_run(seq: Column | str, any_letter: bool = True) -> Column:
    """Longest homopolymer; of A, C, G, T alone unless ``any_letter``."""
    runs = r"((.)\2*)" if any_letter else "(A+|C+|G+|T+)"
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(F.upper(col(seq)), F.lit(runs), F.lit(1)), F.length)), F.lit(0))


def has_run(seq: Column | str, least: int, any_letter: bool = True) -> Column:
    """Whether :func:`longest_run` is ``least`` (1 at least) or more, without
    taking the sequence apart into its runs."""
    pattern = rf"(.)\1{{{least - 1}}}" if any_letter else "|".join(f"{x}{{{least}}}" for x in "ACGT")
    return F.coalesce(F.regexp_like(F.upper(col(seq)), F.lit(pattern)), F.lit(False))


def low_complexity(seq: Column | str, share: float = 0.8) -> Column:
    """Empty, or one letter makes up more than ``share`` of it."""
    s = F.upper(col(seq))
    letters = F.array_distinct(F.split(s, ""))
    top = F.array_max(F.transform(letters, lambda x: F.length(s) - F.length(F.replace(s, x, F.lit("")))))
    # where there are only A, C, G and T nothing is taken apart
    counts = [count_of(s, x) for x in "ACGT"]
    plain = sum(counts[1:], counts[0]) == F.length(s)
    return (F.length(s) == 0) | F.when(plain, F.greatest(*counts) > share * F.length(s)).otherwise((F.size(letters) == 1) | (top > share * F.length(s)))


def usable(seq: Column | str, least: int = 12) -> Column:
    return (F.length(col(seq)) >= least) & ~low_complexity(seq)


def kmers(seq: Column | str, k: int) -> Column:
    """All overlapping k-mers in order; empty if the sequence is shorter. One
    pass of a pattern, which a substring for each place would not be."""
    return F.regexp_extract_all(col(seq), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def positions(seq: Column | str, motif: str) -> Column:
    """0-based starts of ``motif`` (a pattern may stand for letters), overlaps included.

    The sequence is split before each occurrence, and the pieces' starts are
    counted up: linear in its length.
    """
    s = F.upper(col(seq))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda x, piece: F.struct((x["at"] + F.length(piece)).alias("at"), F.concat(x["out"], F.array(x["at"])).alias("out"))
    starts = F.aggregate(F.split(s, f"(?={motif})"), start, step, lambda x: x["out"])
    return F.filter(starts, lambda x: (x > 0) | F.regexp_like(s, F.lit(f"^(?:{motif})")))


def site_positions(seq: Column | str, motif: str) -> Column:
    """0-based starts of a site on either strand, each once, ascending."""
    other = motif[::-1].translate(str.maketrans(BASES, PAIRED))
    return positions(seq, motif) if other == motif else F.array_sort(F.array_union(positions(seq, motif), positions(seq, other)))


def first_positions(seq: Column | str, motif: str, most: int) -> Column:
    """The first ``most`` of :func:`site_positions`; the sequence is split
    before those alone, by one pattern of both strands."""
    s, either = F.upper(col(seq)), "|".join(dict.fromkeys((motif, motif[::-1].translate(str.maketrans(BASES, PAIRED)))))
    # a place at the very start makes no piece, so one piece more is cut
    sizes = F.transform(F.split(s, f"(?={either})", most + 1), F.length)
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.get(out, F.size(out) - 1) + n)))
    skip = F.when(F.regexp_like(s, F.lit(f"^(?:{either})")), 1).otherwise(2)
    # in an array, so that the places are worked out once
    return F.get(F.transform(F.array(ends), lambda e: F.slice(e, skip, F.least(F.lit(most), F.size(e) - skip))), F.lit(0))


def codons(seq: Column | str) -> Column:
    """Whole codons in order; matched in one pass, linear in the length."""
    return F.regexp_extract_all(F.upper(col(seq)), F.lit("(?s).{3}"), F.lit(0))


def amino_acid(codon: Column | str) -> Column:
    """One letter of the standard code, ``*`` for a stop, X for other letters."""
    c = F.upper(col(codon))
    place = [F.instr(F.lit(CODON_ORDER), F.substr(c, F.lit(i), F.lit(1))) for i in (1, 2, 3)]
    whole = (F.length(c) == 3) & (place[0] > 0) & (place[1] > 0) & (place[2] > 0)
    return F.when(whole, F.substr(F.lit(AMINO_ACIDS), 16 * (place[0] - 1) + 4 * (place[1] - 1) + place[2], F.lit(1))).otherwise("X")


def has_site(seq: Column | str, motif: str) -> Column:
    """Whether a site lies on either strand."""
    return site_in(F.upper(col(seq)), motif)


def site_in(s: Column, motif: str) -> Column:
    """:func:`has_site` of a sequence in upper case."""
    return F.contains(s, F.lit(motif)) | F.contains(s, F.lit(motif[::-1].translate(str.maketrans(BASES, PAIRED))))


def internal_stop(seq: Column | str) -> Column:
    """A stop codon before the run of stops that ends the frame: one pattern
    finds stops that a whole other codon follows."""
    stop = "|".join(STOPS)
    return F.regexp_like(F.upper(col(seq)), F.lit(f"(?s)^(?:.{{3}})*?(?:{stop})++(?!{stop}).{{3}}"))


def has_start(seq: Column | str) -> Column:
    return F.substring(F.upper(col(seq)), 1, 3).isin(*STARTS)


def next_start(seq: Column | str, after: Column, window: int = 40) -> Column:
    """0-based start of the first ATG in ``window`` bases from ``after``
    (0-based), or null."""
    at = F.instr(F.substr(F.upper(col(seq)), after + 1, F.lit(window + 2)), "ATG")
    return F.when(at > 0, after + at - 1)


def best_shine_dalgarno(seq: Column | str, least: int = 4) -> Column:
    """struct(score, start): the 6-mer most like AGGAGG with ``least``
    letters agreeing, the last of equals; null without one."""
    scored = F.transform(
        kmers(F.upper(col(seq)), len(SHINE_DALGARNO)),
        lambda m, i: F.struct(sum(F.when(F.substr(m, F.lit(j + 1), F.lit(1)) == x, 1).otherwise(0) for j, x in enumerate(SHINE_DALGARNO)).alias("score"), i.alias("start")),
    )
    best = F.array_max(scored)
    return F.when(best["score"] >= least, best)


def trimmed(seq: Column | str, three_prime: Column, five_prime: Column) -> Column:
    """The sequence without its 3' trim, then without its 5' trim; null where
    a trim is not found there (the caller blocks)."""
    s, three, five = F.upper(col(seq)), F.upper(F.coalesce(three_prime, F.lit(""))), F.upper(F.coalesce(five_prime, F.lit("")))
    cut = F.when(F.endswith(s, three), F.substr(s, F.lit(1), F.length(s) - F.length(three)))
    return F.when(F.startswith(cut, five), F.substr(cut, F.length(five) + 1, F.length(cut)))


def identity_percent(matches: Column, window: Column) -> Column:
    return F.round(100.0 * matches / window, 1)


def wrapped(seq: Column | str, width: int = 80) -> Column:
    """Lines of ``width``, each ended by a newline but the last."""
    return F.regexp_replace(col(seq), f"(.{{{width}}})(?=.)", "$1\n")


def origin_block(seq: Column | str) -> Column:
    """Numbered lines of sixty in tens, as flat files show sequences."""
    s = F.lower(col(seq))
    rows = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(s) - 1) / 60).cast("int")),
        lambda i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.trim(F.regexp_replace(F.substr(s, i * 60 + 1, F.lit(60)), "(.{10})", "$1 "))),
    )
    return F.when(F.length(s) > 0, F.array_join(rows, "\n")).otherwise("")


def registry_hint(source: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(source), r"(BBa_[A-Za-z0-9_]*)", 1), F.lit(""))


def location(loc: Column | str) -> Column:
    """struct(start, end, strand) of a feature location: complement, join,
    open ends and single bases; the outermost bases of a join."""
    text = F.translate(col(loc), "<>", "")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.struct(F.array_min(numbers).alias("start"), F.array_max(numbers).alias("end"), F.when(F.contains(text, F.lit("complement")), -1).otherwise(1).alias("strand"))


def circular_slice(seq: Column | str, start: Column, end: Column) -> Column:
    """Bases start..end of a circle; ``end`` may pass its length."""
    return F.substr(F.concat(col(seq), col(seq)), start, end - start + 1)


def stretch(seq: Column | str, start: Column, end: Column) -> Column:
    """Bases start..end of a record; past its length they go on at its origin."""
    start, end = start.cast("int"), end.cast("int")
    return F.when(end > F.length(col(seq)), circular_slice(seq, start, end)).otherwise(F.substr(col(seq), start, end - start + 1))


def circular_location(loc: Column | str, length: Column) -> Column:
    """:func:`location` on a circle of ``length`` bases: where a piece ends at
    the length and the next begins at 1, the whole ends past the length."""
    at = location(loc)
    pieces = F.transform(F.regexp_extract_all(F.translate(col(loc), "<>", ""), F.lit(r"(\d+\.\.\d+)"), F.lit(1)), lambda x: F.transform(F.split(x, r"\.\."), lambda y: y.cast("int")))
    over = F.exists(F.transform(pieces, lambda x, i: (x[1] == length) & F.coalesce(F.get(pieces, i + 1)[0] == 1, F.lit(False))), lambda x: x)
    last = F.get(pieces, F.size(pieces) - 1)[1]
    return F.struct(F.when(over, F.get(pieces, F.lit(0))[0]).otherwise(at["start"]).alias("start"), F.when(over, length + last).otherwise(at["end"]).alias("end"), at["strand"].alias("strand"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """struct(mismatches, first, delta): over the common length, the 1-based
    first difference (null without), and the difference of lengths."""
    a, b = col(a), col(b)
    n = F.least(F.length(a), F.length(b))
    differ = F.when(n > 0, F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.struct(F.size(differ).alias("mismatches"), F.get(differ, F.lit(0)).alias("first"), (F.length(b) - F.length(a)).alias("delta"))


def best_segment(query: Column, reference: Column) -> Column:
    """struct(score, start, end, matches) of the maximal run of two aligned
    strings of equal length, +1 for equal letters and -1 for others; 0-based,
    end exclusive, the first of equal runs; matches over the whole window.

    The walk goes over runs of equal and of differing letters, not letters."""
    marks = F.array_join(F.zip_with(F.split(query, ""), F.split(reference, ""), lambda x, y: F.when(x == y, "1").otherwise("0")), "")
    steps = F.transform(F.regexp_extract_all(marks, F.lit("(1+|0+)"), F.lit(1)), lambda r: F.when(F.startswith(r, F.lit("1")), F.length(r)).otherwise(-F.length(r)))
    zero = F.struct(*[F.lit(0).alias(x) for x in ("now", "low", "i", "best", "start", "end", "matches")])

    def step(s: Column, x: Column) -> Column:
        fresh, size = s["now"] <= 0, F.abs(x)
        now, low = F.when(fresh, x).otherwise(s["now"] + x), F.when(fresh, s["i"]).otherwise(s["low"])
        better = now > s["best"]
        return F.struct(
            now.alias("now"), low.alias("low"), (s["i"] + size).alias("i"), F.when(better, now).otherwise(s["best"]).alias("best"), F.when(better, low).otherwise(s["start"]).alias("start"),
            F.when(better, s["i"] + size).otherwise(s["end"]).alias("end"), (s["matches"] + F.greatest(x, F.lit(0))).alias("matches"),
        )

    return F.aggregate(steps, zero, step, lambda s: F.struct(s["best"].alias("score"), s["start"].alias("start"), s["end"].alias("end"), s["matches"].alias("matches")))


def longest_clean(query: Column, reference: Column, least: int, share: tuple[int, int] = (4, 5)) -> Column:
    """struct(start, end, matches) of the longest window, the leftmost of
    equals, of two aligned strings in which at least ``share`` of the letters
    agree; null if none has ``least`` letters. 0-based, end exclusive.

    A window fits if a running balance doesn't fall over it; the longest is
    found by one walk along the balance's lowest value so far and its highest
    value to come.
    """
    need, of = share
    marks = F.array_join(F.zip_with(F.split(query, ""), F.split(reference, ""), lambda x, y: F.when(x == y, "1").otherwise("0")), "")
    n = F.length(query)
    matched = F.transform(F.sequence(F.lit(0), n), lambda i: F.length(F.replace(F.substr(marks, F.lit(1), i), F.lit("0"), F.lit(""))))
    # held in one-element arrays, so that each is worked out once
    pre = F.array(matched)

    def walk(m: Column) -> Column:
        balance = F.array(F.transform(m, lambda x, i: x * of - i * need))

        def edges(b: Column) -> Column:
            low = F.transform(b, lambda x, i: F.array_min(F.slice(b, F.lit(1), i + 1)))
            high = F.transform(b, lambda x, i: F.array_max(F.slice(b, i + 1, F.size(b) - i)))
            return F.struct(low.alias("low"), high.alias("high"))

        def follow(e: Column) -> Column:
            size = F.size(e["low"])
            start = F.struct(*[F.lit(0).alias(x) for x in ("i", "j", "start", "end")])

            def step(s: Column, _: Column) -> Column:
                done = s["j"] >= size
                fits = ~done & (F.get(e["high"], s["j"]) >= F.get(e["low"], s["i"]))
                better = fits & (s["j"] - s["i"] > s["end"] - s["start"])
                return F.struct(
                    F.when(done | fits, s["i"]).otherwise(s["i"] + 1).alias("i"), F.when(fits, s["j"] + 1).otherwise(s["j"]).alias("j"),
                    F.when(better, s["i"]).otherwise(s["start"]).alias("start"), F.when(better, s["j"]).otherwise(s["end"]).alias("end"),
                )

            return F.aggregate(F.sequence(F.lit(1), size * 2), start, step)

        best = F.transform(F.transform(balance, edges), follow)
        return F.transform(best, lambda x: F.when(x["end"] - x["start"] >= least, F.struct(x["start"].alias("start"), x["end"].alias("end"), (F.get(m, x["end"]) - F.get(m, x["start"])).alias("matches"))))

    return F.when(n > 0, F.get(F.get(F.transform(pre, walk), F.lit(0)), F.lit(0)))
