"""Every registered query of the weather and question-log jobs."""

from agro_jobs.plans import answers, atlas, further, landed, language, log, meaning, more, moreover, moving, texts, weather  # noqa: F401
from agro_jobs.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
