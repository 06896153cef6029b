from showerframe.cli import main

main()
