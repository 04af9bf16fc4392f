"""Column expressions; all of them stay inside the JVM but for the JSON repair of ``json_repair``."""
