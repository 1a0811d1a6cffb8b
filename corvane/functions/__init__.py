"""Column functions: text, nested values, dates, sampling, arithmetic. All stay in the JVM unless a docstring says otherwise."""
