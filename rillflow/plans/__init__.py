"""Plan building blocks shared by the operators: materialised tables, traces, ranks."""
