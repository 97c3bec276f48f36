"""Column functions shared by every operator; all stay inside the JVM."""
