"""gradewright.functions"""
