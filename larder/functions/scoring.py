"""Recipe-likelihood score: weak signals that agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import NOT_WS, WORD_END, WORD_START, WS, js_round, let, normalise_text

# Vocabulary and weights of the score.
UNITS = (
    r"(?:g|kg|ml|l|oz|lb|lbs|cup|cups|tsp|tbsp|teaspoons?|tablespoons?|cloves?|pinch|handful"
    r"|slices?|sticks?|cans?|tins?|pints?|quarts?|mins?|minutes?|hrs?|hours?|scoops?|sprigs?"
    r"|bunch|dash|pkg|packets?)"
)
NUMBER = (rf"(?:\d+(?:[.,]\d+)?(?:{WS}*/{WS}*\d+)?|\d+{WS}+\d+{WS}*/{WS}*\d+|[½⅓⅔¼¾⅛⅜⅝⅞])")
VERBS = (
    r"preheat|bake|baked|baking|mix|stir|whisk|fold|chop|dice|diced|mince|minced|fry"
    r"|air[- ]?fry|boil|simmer|roast|grill|blend|marinate|season|drain|knead|pour|combine"
    r"|garnish|sprinkle|toss|serve|serves|cook|cooked|heat|melt|spread|layer|refrigerate|chill"
    r"|rest|sear|steam|whip|coat|brush|skillet|oven|saucepan"
)
HEADINGS = (
    r"ingredients?|method|directions?|instructions?|steps?|you(?:'|’)?ll need|what you need"
    r"|shopping list|recipe below|full recipe"
)
THRESHOLD = 4.0

# What may stand in front of a quantity in a list.
BULLETS = r"[-*•–—·▪\x{FE0F}>]"
_NUMBER_UNIT = rf"(?i)(?:\A|{WS}|[(\[]){NUMBER}{WS}*-?{WS}*{UNITS}{WORD_END}"
_QUANTITY_LINE = rf"^{WS}*(?:{BULLETS}|\d+[.)])?{WS}*{NUMBER}{WS}*{NOT_WS}"
# An accented final letter is no ASCII word character, so its boundary is on the other side.
# Verbs by their first letter: one test a letter, not one a verb. Whole words are met, so their order is free.
_BY_LETTER = "|".join(
    f"{a}(?:{'|'.join(v[1:] for v in f'{VERBS}|saute'.split('|') if v[0] == a)})"
    for a in sorted({v[0] for v in f"{VERBS}|saute".split("|")}))
_VERB = rf"(?i){WORD_START}(?:(?:{_BY_LETTER}){WORD_END}|saut[éÉ](?=[A-Za-z0-9_]))"
_HEADING = rf"(?i){WORD_START}(?:{HEADINGS}){WORD_END}"
_HASHTAG = rf"(?:\A|{WS})#[\p{{L}}\p{{N}}_]+"


def score_text(text: Column) -> Column:
    """Normalised text with hashtags removed: what the signals look at."""
    return F.regexp_replace(normalise_text(text), _HASHTAG, " ")


def distinct_verbs(clean: Column) -> Column:
    found = F.regexp_extract_all(clean, F.lit(_VERB), F.lit(0))
    return F.size(F.array_distinct(F.transform(found, F.lower)))


def quantity_lines(clean: Column) -> Column:
    return F.size(F.filter(
        F.split(clean, "\n"), lambda l: F.regexp_like(l, F.lit(_QUANTITY_LINE))))


def raw_score_of_clean(clean: Column) -> Column:
    """Unrounded score of already cleaned text; the gate compares this one."""
    score = (
        F.least(F.regexp_count(clean, F.lit(_NUMBER_UNIT)), F.lit(8)) * F.lit(0.9)
        + F.least(quantity_lines(clean), F.lit(8)) * F.lit(0.6)
        + F.least(distinct_verbs(clean), F.lit(8)) * F.lit(0.45)
        + F.least(F.regexp_count(clean, F.lit(_HEADING)), F.lit(3)) * F.lit(1.2)
        + F.when(F.char_length(clean) > 350, F.lit(0.8)).otherwise(F.lit(0.0)))
    return F.when(F.coalesce(F.char_length(clean), F.lit(0)) < 40, F.lit(0.0)).otherwise(score)


def raw_score(text: Column) -> Column:
    return let(score_text(text), raw_score_of_clean)


def round_score(score: Column) -> Column:
    return js_round(score * 100) / 100


def is_recipe(score: Column) -> Column:
    return score >= F.lit(THRESHOLD)
