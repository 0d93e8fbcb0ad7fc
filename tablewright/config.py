"""Settings that define what counts as messy and how it is repaired.

Everything here is immutable driver-side metadata.  Column roles are decided
by name, so resolving them never touches the data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

# --- Fixed values: tokens that stand for a missing value (compared after
# trimming and lower-casing).
PLACEHOLDERS = (
    "n/a", "na", "null", "none", "nan", "empty", "missing", "unknown",
    "undefined", "nil", "not available", "not applicable", "not disclosed",
    "#n/a", "-", "--", "---", "?", ".", "0000-00-00", "1900-01-01",
)

# --- Fixed values: name keywords that give a column its role.
DATE_WORDS = ("date", "time", "dob", "birth", "created", "updated",
              "modified", "timestamp", "at")
TITLE_WORDS = ("name", "department", "dept", "category", "type", "status",
               "gender", "sex", "city", "country", "state", "region",
               "district", "title", "role", "position", "occupation", "subject")
LOWER_WORDS = ("email", "url", "website", "domain", "username", "user",
               "login", "handle", "slug")
SKIP_OUTLIER_WORDS = ("id", "code", "zip", "postal", "phone", "mobile",
                      "year", "flag", "bool", "index")
AGE_WORDS = ("age",)
EMAIL_WORDS = ("email",)
PHONE_CHECK_WORDS = ("phone", "mobile", "tel", "contact")
PHONE_REPAIR_WORDS = ("phone", "mobile", "tel")
DATE_CHECK_WORDS = ("date", "birth", "dob")
BIRTH_WORDS = ("birth", "dob")
NEAR_DUPLICATE_WORDS = ("name", "title", "description", "label")
NON_NUMERIC_WORDS = ("name", "email", "url", "address", "description",
                     "comment", "note", "text", "label", "tag")
MONEY_WORDS = ("salary", "income", "amount")
KEY_WORDS = ("id", "email", "name")

# --- Fixed values: shapes of a valid email address and phone number.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^\+?[\d\s\-().]{7,15}$"


@dataclass(frozen=True)
class Rule:
    """A check of one's own: what makes a value of certain columns wrong, and what to put in its place.

    ``condition`` and ``repair`` are SQL expressions in which ``{value}`` stands for the column; without a repair wrong values
    are reported only.  A rule holds for columns named in ``columns`` or whose names hold one of ``words``.  Plain
    text, so that a fitted plan with such a rule can be stored and applied again.
    """

    name: str
    condition: str
    words: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    repair: str | None = "NULL"


@dataclass(frozen=True)
class Config:
    """All thresholds and switches.

    The defaults follow the established workflow this engine replaces, down
    to its order of repairs.  ``Config.recommended()`` is the variant for new
    users: formats are normalised and impossible values removed before
    anything is imputed, key-like columns are never filled with a mode, and
    accents survive.
    """

    placeholders: tuple[str, ...] = PLACEHOLDERS
    iqr_multiplier: float = 1.5
    z_threshold: float = 3.0
    # Columns with fewer values have no outliers; part of what an outlier is.
    min_outlier_rows: int = 10
    similarity_threshold: int = 92
    near_constant_share: float = 0.995
    near_constant_min_rows: int = 2
    missing_drop_share: float = 0.60
    median_below_share: float = 0.05
    median_from_share: float = 0.30
    date_parse_share: float = 0.70
    date_reparse_share: float = 0.50
    numeric_parse_share: float = 0.70
    age_report_range: tuple[float, float] = (0.0, 150.0)
    age_repair_range: tuple[float, float] = (0.0, 120.0)

    name_matching: str = "substring"        # or "token"
    order: str = "reference"                # or "repair_first"
    fold_ascii: bool = True
    blank_cells_to_null: bool = False
    iso_dates_as_text: bool = True
    impute_key_columns: bool = True
    nullify_bad_dates: bool = False

    near_duplicate_column: str = "_near_duplicate"
    # Rows back that a row is compared with; None for the whole table before it.
    near_duplicate_window: int | None = None
    near_duplicate_mode: str = "any_earlier"   # or "greedy"; "lsh" for long texts
    blanks_match: bool = False

    rules: tuple[Rule, ...] = ()

    examples: int = 5
    # Above this many rows quantiles come from bracket refinement instead of
    # the built-in exact aggregate, whose buffer grows with distinct values.
    exact_quantile_rows: int = 100_000

    @classmethod
    def recommended(cls, **changes) -> "Config":
        base = cls(order="repair_first", fold_ascii=False,
                   blank_cells_to_null=True, impute_key_columns=False,
                   nullify_bad_dates=True, name_matching="token")
        return replace(base, **changes)

    def with_(self, **changes) -> "Config":
        return replace(self, **changes)

    def rules_for(self, column: str) -> list[Rule]:
        return [r for r in self.rules if column in r.columns or (r.words and self.has_role(column, r.words))]

    def has_role(self, column: str, words: tuple[str, ...]) -> bool:
        """True when the column name carries one of the role keywords."""
        name = column.lower()
        if self.name_matching == "token":
            tokens = re.sub(r"[^0-9a-z]+", " ",
                            re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", column).lower()).split()
            return any(w in tokens for w in words)
        return any(w in name for w in words)


DEFAULT = Config()
