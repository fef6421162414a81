"""quarrylens: source-code intelligence as Spark DataFrame algebra."""
