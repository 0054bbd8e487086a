"""Rule tables compiled to one JVM-side CASE expression.

A rule set is data: an ordered list of ``Rule`` rows.  ``classify`` turns it
into a single ``CASE WHEN`` over the (lower-cased) text, first match wins,
so later rules can be shadowed by earlier ones exactly as in the source
study.  Exact lists become ``InSet`` hash lookups; substrings become
``contains`` tests; everything is whole-stage codegen'd.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelog.functions.util import col, first_match


@dataclass(frozen=True)
class Rule:
    code: int
    exact: tuple[str, ...] = ()
    contains: tuple[str, ...] = ()
    # (substring, exception): matches when the substring occurs and the exception does not
    contains_unless: tuple[tuple[str, str], ...] = ()
    name: str = ""

    def predicate(self, text: Column) -> Column:
        preds = []
        if self.exact:
            preds.append(text.isin(*self.exact))
        if self.contains:
            preds.append(F.exists(F.array(*map(F.lit, self.contains)), lambda s: text.contains(s)))
        preds += [text.contains(s) & ~text.contains(e) for s, e in self.contains_unless]
        out = preds[0]
        for p in preds[1:]:
            out = out | p
        return out


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rules_sql(column: str, rules, default=None) -> str:
    """The rule table as one SQL ``CASE`` over ``column`` (already lower-cased)."""
    c = f"`{column}`"
    parts = []
    for r in rules:
        preds = []
        if r.exact:
            preds.append(f"{c} IN ({', '.join(_lit(x) for x in r.exact)})")
        if r.contains:
            preds.append(f"exists(array({', '.join(map(_lit, r.contains))}), _s -> contains({c}, _s))")
        preds += [f"(contains({c}, {_lit(x)}) AND NOT contains({c}, {_lit(e)}))" for x, e in r.contains_unless]
        parts.append(f"WHEN {' OR '.join(preds)} THEN {int(r.code)}")
    tail = f" ELSE {int(default)}" if default is not None else ""
    return "CASE " + " ".join(parts) + tail + " END"


def classify(text, rules, lower: bool = True, default=None) -> Column:
    """Ordered rule classification of a text column (NULL text -> default).

    Given a column *name* of already lower-cased text (``lower=False``) the
    rule table is compiled to one SQL CASE (a single expression parse);
    otherwise it is assembled from Column predicates."""
    if isinstance(text, str) and not lower:
        return F.expr(rules_sql(text, rules, default))
    t = F.lower(col(text)) if lower else col(text)
    expr = first_match([(r.predicate(t), r.code) for r in rules])
    if default is not None:
        expr = expr.otherwise(F.lit(default))
    return expr


# ---------------------------------------------------------------------------
# Respiratory-support vocabulary of the study (lower-case
# text), in the study's rule order.  Codes: 4 invasive ventilation,
# 3 non-invasive ventilation, 2 either, 1 supplemental oxygen, 0 oxygen
# therapy of unknown type, -1 more oxygen than room air.
# ---------------------------------------------------------------------------
OXYGEN_SUPPORT_RULES: tuple[Rule, ...] = (
    Rule(4, name="invasive",
         exact=("plateau pressure", "postion at lip", "position at lip", "pressure control"),
         contains=("set vt", "sputum", "rsbi", "tube", "ett", "endotracheal", "tracheal suctioning",
                   "tracheostomy", "reintubation", "assist controlled", "volume controlled",
                   "pressure controlled", "trach collar")),
    Rule(3, name="noninvasive",
         exact=("bi-pap", "ambubag"),
         contains=("ipap", "niv", "epap", "mask leak", "volume assured", "non-invasive ventilation",
                   "cpap")),
    Rule(2, name="either",
         exact=("flowtrigger", "peep", "tv/kg ibw", "mean airway pressure", "peak insp. pressure",
                "exhaled mv", "exhaled tv (machine)", "exhaled tv (patient)", "flow sensitivity",
                "peak flow", "f total", "pressure to trigger ps", "adult con setting set rr",
                "adult con setting set vt", "vti", "exhaled vt", "adult con alarms hi press alarm",
                "mve", "respiratory phase", "inspiratory pressure, set", "a1: high exhaled vt",
                "set fraction of inspired oxygen (fio2)", "insp flow (l/min)",
                "adult con setting spont exp vt", "spont tv", "pulse ox results vt",
                "vt spontaneous (ml)", "peak pressure", "ltv1200", "tc"),
         contains_unless=(("vent", "hyperventilat"),),
         contains=("tidal", "flow rate", "minute volume", "leak", "pressure support", "peep",
                   "tidal volume")),
    Rule(1, name="supplemental",
         exact=("t-piece", "blow-by", "oxyhood", "nc", "oxymizer", "hfnc", "oximizer", "high flow",
                "oxymask", "nch", "hi flow", "hiflow", "hhfnc", "nasal canula", "face tent",
                "high flow mask", "aerosol mask", "venturi mask", "cool aerosol mask", "simple mask",
                "face mask"),
         contains=("nasal cannula", "non-rebreather", "nasal mask", "face tent")),
    Rule(0, name="unknown_type",
         exact=("pressure support", "rr spont", "ps", "insp cycle off (%)", "trach mask/collar"),
         contains=("spontaneous", "oxygen therapy")),
    Rule(-1, name="extra_oxygen", exact=("lpm o2",)),
)

# Respiratory-charting labels whose *value* names the device.
DEVICE_LABELS = ("o2 device", "respiratory device", "ventilator type", "oxygen delivery method")


def oxygen_support_code(text, lower: bool = True) -> Column:
    return classify(text, OXYGEN_SUPPORT_RULES, lower=lower)
