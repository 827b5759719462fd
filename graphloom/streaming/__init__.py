"""graphloom.streaming"""
