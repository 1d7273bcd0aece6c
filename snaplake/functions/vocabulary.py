"""Names of skills in the data-engineering market: spellings, names, and what stands for what.

Configuration, held by the driver; plans read it as tables that meet the data in joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snaplake.functions.text import vocabulary_table

# Other spellings of a name, as they have to be for right results.
ALIASES = {
    "azure databricks": "databricks", "databricks unified data analytics platform": "databricks", "databricks lakehouse": "databricks",
    "lakehouse": "databricks", "delta": "delta lake", "delta tables": "delta lake", "uc": "unity catalog", "workflows": "databricks workflows",
    "databricks jobs": "lakeflow jobs", "dabs": "databricks asset bundles", "asset bundles": "databricks asset bundles",
    "declarative automation bundles": "databricks asset bundles", "genie spaces": "genie", "genie space": "genie", "genie agents": "genie",
    "ai/bi genie": "genie", "py spark": "pyspark", "apache spark": "spark", "sparksql": "spark sql", "t-sql": "sql", "pl/sql": "sql", "adls": "azure",
    "adls gen2": "azure", "azure data factory": "azure", "adf": "azure", "s3": "aws", "glue": "aws", "amazon web services": "aws",
    "dlt": "delta live tables", "lakeflow declarative pipelines": "delta live tables", "lakeflow spark declarative pipelines": "delta live tables",
    "autoloader": "auto loader", "spark streaming": "structured streaming", "star schema": "dimensional modelling", "data modeling": "data modelling",
    "dimensional modeling": "dimensional modelling", "slowly changing dimensions": "scd", "gen ai": "generative ai", "genai": "generative ai",
    "large language models": "llm", "llms": "llm", "model context protocol": "mcp", "cicd": "ci/cd", "ci cd": "ci/cd", "azure devops": "ci/cd",
    "github actions": "ci/cd", "jenkins": "ci/cd", "scrum": "agile", "iics": "informatica iics", "informatica": "informatica iics",
    "amazon quicksight": "quicksight", "powerbi": "power bi", "databricks sql": "sql warehouse", "sql warehouses": "sql warehouse",
    "azure data lake storage": "azure", "azure data lake": "azure", "azure synapse": "synapse", "azure synapse analytics": "synapse", "github": "git",
    "kimball": "dimensional modelling", "dimensional data modeling": "dimensional modelling", "dimensional data modelling": "dimensional modelling",
    "medallion": "medallion architecture", "performance optimization": "performance tuning", "performance optimisation": "performance tuning",
    "query optimization": "performance tuning", "query optimisation": "performance tuning", "spark optimization": "performance tuning",
    "data lakehouse": "databricks", "large language model": "llm",
}

# Names known whoever's profile it is.
MARKET_TERMS = [
    "python", "sql", "scala", "java", "spark", "pyspark", "spark sql", "databricks", "delta lake", "unity catalog", "sql warehouse", "lakeflow jobs",
    "databricks workflows", "delta live tables", "auto loader", "structured streaming", "databricks asset bundles", "databricks apps",
    "databricks dashboards", "mlflow", "genie", "genie code", "liquid clustering", "photon", "etl", "elt", "data pipelines", "medallion architecture",
    "data modelling", "dimensional modelling", "scd", "data quality", "data governance", "data warehousing", "big data", "distributed computing",
    "orchestration", "performance tuning", "incremental loads", "version control", "git", "ci/cd", "agile", "rest api", "airflow", "dbt", "kafka",
    "flink", "hadoop", "hive", "snowflake", "redshift", "bigquery", "synapse", "fabric", "informatica iics", "azure", "aws", "gcp", "cloud",
    "terraform", "docker", "kubernetes", "event hubs", "kinesis", "mongodb", "cassandra", "postgresql", "nosql", "power bi", "tableau", "looker",
    "quicksight", "llm", "generative ai", "mcp", "rag", "vector search", "machine learning", "healthcare", "hipaa", "financial services", "banking",
    "insurance",
]

# Who has any of the listed skills covers the one in front.
EQUIVALENT = {
    "spark": ["pyspark", "spark sql"],
    "pyspark": ["spark"],
    "big data": ["spark", "pyspark", "databricks"],
    "distributed computing": ["spark", "pyspark", "databricks"],
    "data warehousing": ["snowflake", "dimensional modelling", "data modelling"],
    "data pipelines": ["etl", "elt"],
    "cloud": ["azure", "aws"],
    "orchestration": ["lakeflow jobs", "databricks workflows"],
    "data governance": ["unity catalog"],
    "version control": ["git"],
}

# Tools whose mention in a generated text needs a source.
TOOLS = [
    "kafka", "airflow", "dbt", "hadoop", "hive", "flink", "kubernetes", "docker", "terraform", "gcp", "bigquery", "redshift", "synapse", "fabric",
    "scala", "java", "mongodb", "cassandra", "tableau", "looker", "mlflow", "sagemaker", "structured streaming", "auto loader", "delta live tables",
    "event hubs", "kinesis", "snowflake", "informatica iics", "power bi", "quicksight", "azure", "aws", "unity catalog", "genie", "genie code", "mcp",
    "pyspark", "spark", "databricks asset bundles", "databricks apps", "liquid clustering", "python", "sql",
]


def spellings(*more: str) -> dict[str, str]:
    """Every spelling and its name: market terms, what aliases stand for, ``more`` names, and the aliases."""
    return {name: name for name in [*MARKET_TERMS, *ALIASES.values(), *more]} | ALIASES


def tool_spellings(*more: str) -> dict[str, str]:
    """Spellings of the tools and ``more`` names, with the aliases that stand for one of them."""
    names = {*TOOLS, *more}
    return {name: name for name in [*TOOLS, *more]} | {alias: name for alias, name in ALIASES.items() if name in names}


def market_table(spark: SparkSession, *more: str) -> DataFrame:
    """``term, name`` of :func:`spellings`."""
    return vocabulary_table(spark, spellings(*more))
