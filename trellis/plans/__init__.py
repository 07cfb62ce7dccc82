"""The operators at work on the driver's tables: registered queries, each with SQL for the same rows where SQL has it."""
