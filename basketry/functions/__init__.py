from basketry.functions.exprs import *  # noqa: F401,F403
from basketry.functions.ordinal import ordinal, running_totals, hash_bucket  # noqa: F401
