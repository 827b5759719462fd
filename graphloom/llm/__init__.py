"""graphloom.llm"""
