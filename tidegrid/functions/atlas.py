"""Region vocabularies and the custom network rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Network code vocabularies.
YEO7_SHORT = {
    "7Networks_1": "Visual",
    "7Networks_2": "Somatomotor",
    "7Networks_3": "Dorsal Attention",
    "7Networks_4": "Ventral Attention",
    "7Networks_5": "Limbic",
    "7Networks_6": "Frontoparietal",
    "7Networks_7": "Default",
}
YEO7_LONG = {
    "7Networks_1": "Visual Network (VN)",
    "7Networks_2": "Somatomotor Network (SMN)",
    "7Networks_3": "Dorsal Attention Network (DAN)",
    "7Networks_4": "Ventral Attention Network (VAN)",
    "7Networks_5": "Limbic Network (LN)",
    "7Networks_6": "Frontoparietal Network (FPN)",
    "7Networks_7": "Default Mode Network (DMN)",
}
YEO17 = {
    "17Networks_1": "Visual Central (Visual A)",
    "17Networks_2": "Visual Peripheral (Visual B)",
    "17Networks_3": "Somatomotor A",
    "17Networks_4": "Somatomotor B",
    "17Networks_5": "Dorsal Attention A",
    "17Networks_6": "Dorsal Attention B",
    "17Networks_7": "Salience / Ventral Attention A",
    "17Networks_8": "Salience / Ventral Attention B",
    "17Networks_9": "Limbic A",
    "17Networks_10": "Limbic B",
    "17Networks_11": "Control C",
    "17Networks_12": "Control A",
    "17Networks_13": "Control B",
    "17Networks_14": "Temporal Parietal",
    "17Networks_15": "Default C",
    "17Networks_16": "Default A",
    "17Networks_17": "Default B",
}
VOCABULARIES = {"y7_short": YEO7_SHORT, "y7_long": YEO7_LONG, "y17": YEO17, "raw": {}}

# Custom network membership.
NOT_GRAY = ["White-Matter", "Ventricle", "CSF", "choroid", "Unknown", "WM-hypointensities"]
DMN_DEEP = ["Left-Hippocampus", "Right-Hippocampus", "Left-Amygdala", "Right-Amygdala"]
DMN = [
    "medialorbitofrontal", "rostralanteriorcingulate", "posteriorcingulate", "isthmuscingulate",
    "precuneus", "inferiorparietal", "middletemporal", "temporalpole", "parahippocampal",
    "entorhinal", "frontalpole",
]
FPCN_A = ["rostralmiddlefrontal", "superiorfrontal", "parsopercularis", "parsorbitalis", "parstriangularis"]
FPCN_B = ["caudalmiddlefrontal", "precentral", "postcentral", "superiorparietal", "supramarginal"]


def translate(code: Column, vocabulary: str = "y7_long") -> Column:
    """Name of a network code; anything unknown passes through."""
    names = VOCABULARIES[vocabulary]
    if not names:
        return code
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, code), code)


def network_rule(dk: Column, aparc: Column, not_gray: list[str], deep: dict[str, list[str]],
                 cortical: dict[str, list[str]], fallback: str = "OTHER") -> Column:
    """Excluded substrings first, then exact deep labels, then cortical labels."""
    dk = F.lower(F.trim(dk))
    aparc = F.trim(aparc)
    out = F.when(F.greatest(*[aparc.contains(x) for x in not_gray], F.lit(False)), "EXCLUDE")
    for name, members in deep.items():
        out = out.when(aparc.isin(members), name)
    for name, members in cortical.items():
        out = out.when(dk.isin(members), name)
    return out.otherwise(fallback)


def map_network(dk: Column, aparc: Column) -> Column:
    return network_rule(dk, aparc, NOT_GRAY, {"DMN": DMN_DEEP}, {"DMN": DMN, "FPCN_A": FPCN_A, "FPCN_B": FPCN_B})
