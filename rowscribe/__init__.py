"""rowscribe: tables to text, few-shot sampling and choice scoring as Spark jobs."""
