"""boscograph: a Spark-first engine that builds and queries knowledge graphs of documents."""
