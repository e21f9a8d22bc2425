"""Text normalisation, note tagging and personal-data patterns. Every function returns a Column."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and the plain letter each stands for. Letters outside the map are dropped.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyync"


def norm_text(text: Column) -> Column:
    """Lower-case letters and digits only, accents taken off."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), "[^a-z0-9]", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _merged(endings: list[str]) -> str:
    """A pattern of the given literal texts with common beginnings written once. A text may end in `*`."""
    heads: dict[str, list[str]] = {}
    for ending in endings:
        if ending:
            heads.setdefault(ending[0], []).append(ending[1:])
    branches = [r"\w*" if head == "*" else re.escape(head) + _merged(rest) for head, rest in heads.items()]
    if not branches:
        return ""
    body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
    return f"(?:{body})?" if "" in endings else body


def whole_words(words: tuple[str, ...]) -> str:
    """Pattern of any of the words, whole, for lower-case text; a word ending in * matches its endings
    too. Beginnings are shared, so a word costs a few steps and not one try per alternative."""
    return rf"(?U)(?<!\w){_merged([w.lower() for w in words])}(?!\w)"


# Words of notes written at business premises.
BUSINESS_WORDS = (
    "office*", "oficina*", "despacho", "coworking", "reception", "recepción", "recepcion", "recepció",
    "loading dock", "muelle de carga", "moll de càrrega", "moll de carrega", "22@", "polígono industrial",
    "poligono industrial", "polígon industrial", "horario comercial", "horari comercial",
)
# The premises a note may open with.
BUSINESS_OPENINGS = (
    "shop", "store", "tienda", "botiga", "bar", "cafe", "café", "cafeteria", "cafetería", "restaurant", "restaurante",
)
# Words of notes written at a home.
HOME_WORDS = (
    "casa", "house", "home", "flat", "apartment", "apartamento", "appartamento", "appartement",
    "piso", "pis", "ático", "atico", "àtic", "pral", "entresuelo", "entresòl", "entresol", "entlo", "entl",
    "escalera", "escala", "esc.", "portal", "rellano", "replà", "felpudo",
    "telefonillo", "porter automàtic", "portero automático", "portero automatico", "intercom", "interfono",
    "citofono", "buzón", "buzon", "buzones", "bústia", "bustia", "letterbox", "mailbox",
    "portería", "porteria", "portero", "portera", "porter", "conserje*", "conserge*", "conserjería",
    "consergeria", "concierge", "vecino*", "vecina*", "veí", "veïna", "veïns", "neighbour*", "neighbor*",
    "urbanización", "urbanizacion", "urbanització", "urbanitzacio", "gated community",
    "jardín", "jardin", "jardí", "huerto", "patio", "pati",
    "bebé", "bebe", "baby", "nadó", "recién nacido", "niño", "niña", "nena", "nen", "madre", "mare", "àvia",
    "gato", "gat", "cat", "cats", "perro*", "gos", "gossos", "dog",
    "teletrabajo", "teletreballo", "wfh", "trabajo", "treballo", "feina", "work nights", "working from",
    "turno de noche", "duermo", "despierta", "despierto",
)
# A flat's floor and door ("4º 2ª", "floor door 1").
FLAT_DOOR = r"(?U)(?<!\w)\d+\s*(?:º|°|r|n|t|è)\.?\s+\d+\s*(?:ª|a)(?!\w)|floor,? door \d"
# How a note about business premises may begin.
OPENING = r"(?U)^\W*(?:(?:es|és) una? |it'?s an? )?(?:" + "|".join(BUSINESS_OPENINGS) + r")(?!\w)"
# Places a note may name and their zone; None lies outside the service area.
PLACES = {
    "L'Hospitalet": "Z10",
    "El Prat": "Z11",
    "Cornellà": "Z12",
    "Esplugues": "Z13",
    "Sant Boi": "Z14",
    "22@": "Z09",
    "Vallvidrera": "Z05",
    "Sant Joan Despí": None,
}


def note_context(text: Column, category: Column) -> Column:
    """Who could have written a note: 'business', 'home' or 'neutral'. Opening hours decide first,
    then any sign of a home, then business premises."""
    low = F.lower(text)
    return (
        F.when(category == "business hours", "business")
        .when(low.rlike(f"{whole_words(HOME_WORDS)}|{FLAT_DOOR}"), "home")
        .when(low.rlike(f"{whole_words(BUSINESS_WORDS)}|{OPENING}"), "business")
        .otherwise("neutral")
    )


def places_named(text: Column, places: Mapping[str, str | None]) -> Column:
    """Sorted array of the places a text names as whole words, found in one pass over it. No place's
    name may lie inside another's."""
    names = {place.lower(): place for place in places}
    if any(a != b and a in b for a in names for b in names):
        raise ValueError("a place's name is part of another's; name the longer one only")
    hits = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(whole_words(tuple(names))), F.lit(0)))
    spelt = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.array_sort(F.transform(hits, lambda hit: F.try_element_at(spelt, hit)))


def zones_named(text: Column, places: Mapping[str, str | None], outside: str = "outside") -> Column:
    """Distinct zones of the places a text names; `outside` stands for a place that is not served."""
    zone = F.create_map(*[F.lit(x) for place, z in places.items() for x in (place, z or outside)])
    return F.array_distinct(F.transform(places_named(text, places), lambda place: F.try_element_at(zone, place)))


# Patterns of personal data.
PLATE = r"^\d{4} [BCDFGHJKLMNPRSTVWXYZ]{3}$"
PHONE = r"(?:\+34[\s.-]?)?\b[6789]\d{2}[\s.-]?\d{3}[\s.-]?\d{3}\b"
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.]+\b"
IDENTITY_NUMBER = r"(?i)\b(?:\d{8}|[XYZ]\d{7})[\s-]?[A-Z]\b"


def has_personal_data(text: Column) -> Column:
    return text.rlike(PHONE) | text.rlike(EMAIL) | text.rlike(IDENTITY_NUMBER)


def zero_stripped(number: Column) -> Column:
    """A house number without leading zeros; all zeros become '0'."""
    stripped = F.ltrim(number, F.lit("0"))
    return F.when(stripped == "", "0").otherwise(stripped)


def register_ref(street_code: Column, number: Column, letter: Column) -> Column:
    return F.concat(street_code, F.lit("-"), number, F.trim(letter))


def street_line(
    kind: Column, article: Column, name: Column, first: Column, first_suffix: Column, last: Column, last_suffix: Column
) -> Column:
    """'type article name, 12-14': an article ending in an apostrophe joins the name, no number is s/n."""
    article, name = F.trim(article), F.trim(name)
    full = (
        F.when(article == "", name)
        .when(article.endswith("'"), F.concat(article, name))
        .otherwise(F.concat(article, F.lit(" "), name))
    )
    low = F.concat(F.trim(first), F.trim(first_suffix))
    number = F.when(F.trim(last).isin("", "0"), low).otherwise(
        F.concat(low, F.lit("-"), F.trim(last), F.trim(last_suffix))
    )
    shown = F.when(number.isin("", "0"), "s/n").otherwise(number)
    return F.concat(F.trim(F.concat(F.trim(kind), F.lit(" "), full)), F.lit(", "), shown)
