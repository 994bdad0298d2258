"""Project registry: a fixed dimension of five rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Project(NamedTuple):
    key: str
    label: str
    idea_dir: str
    context_dir: str
    keywords: tuple[str, ...]


# The projects, their target folders and their keywords.
PROJECTS = (
    Project("ufc-betting", "UFC Betting",
            "ufc-betting/01_inbox/ideas", "ufc-betting/01_inbox/context",
            ("ставк", "ufc", "бой", "коэфф", "букмек", "банкрол", "файт", "тотал")),
    Project("venture-investing", "Venture Investing",
            "venture-investing/01_inbox/ideas-cards", "venture-investing/01_inbox/context-cards",
            ("стартап", "венчур", "рынок", "инвест", "deal", "fund", "saas", "компан")),
    Project("learning-programming", "Learning Programming",
            "learning-programming/01_inbox/ideas", "learning-programming/01_inbox/context",
            ("python", "код", "бот", "api", "программ", "разработ", "telegram", "автоматизац")),
    Project("bank-factoring-product", "Bank Factoring Product",
            "bank-factoring-product/01_inbox/ideas", "bank-factoring-product/01_inbox/context",
            ("банк", "факторинг", "продукт", "клиент", "интерфейс", "оплат", "метрик", "процесс")),
    Project("shared", "Shared", "shared/01_inbox/ideas", "shared/01_inbox/context", ()),
)

# Tag words and the projects they stand for.
EXPLICIT_TAGS = {
    "ставки": "ufc-betting",
    "ufc": "ufc-betting",
    "венчур": "venture-investing",
    "инвестиции": "venture-investing",
    "программирование": "learning-programming",
    "код": "learning-programming",
    "банк": "bank-factoring-product",
    "факторинг": "bank-factoring-product",
    "shared": "shared",
}

PROJECT_KEYS = tuple(p.key for p in PROJECTS)


def registry_frame(spark: SparkSession) -> DataFrame:
    rows = [(p.key, p.label, p.idea_dir, p.context_dir, i) for i, p in enumerate(PROJECTS)]
    return spark.createDataFrame(
        rows, "project_key string, project_label string, idea_dir string, context_dir string, ord int"
    )
