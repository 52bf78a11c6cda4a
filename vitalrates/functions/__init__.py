"""Column-level helpers: missing-value semantics, binning, text codes."""

from vitalrates.functions.nulls import (  # noqa: F401
    if_else,
    is_in,
    join_ns,
    safe_div,
    strict_sum,
)
from vitalrates.functions.bins import Bins, cut, decade, label_ordinal  # noqa: F401
from vitalrates.functions.frames import literal_frame  # noqa: F401
from vitalrates.functions.text import (  # noqa: F401
    est_ci_text,
    fixed2,
    number_from_header,
    to_number,
    zero_pad,
)
