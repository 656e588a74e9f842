"""Usage and cost analytics of coding assistants as Spark DataFrame operators."""
